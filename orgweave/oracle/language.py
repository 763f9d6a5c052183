"""DuckDB SQL of the language features and the decision, written out from the lexicons."""

from __future__ import annotations

from orgweave.functions import lexicons as L
from orgweave.functions.language import DEFAULT, Lexicon


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chars(chars: str) -> str:
    return f"(len(x) - len(translate(x, {_q(chars)}, '')))" if chars else "0"


def _any(chars: str) -> str:
    return f"({_chars(chars)} > 0)"


def _ranges(ranges: list[tuple[int, int]]) -> str:
    return "(" + " + ".join(f"len(regexp_replace(x, '[^\\x{{{lo:X}}}-\\x{{{hi:X}}}]', '', 'g'))" for lo, hi in ranges) + ")"


def _count(column: str, part: str) -> str:
    return f"((len({column}) - len(replace({column}, {_q(part)}, ''))) / {len(part)})"


def _positions(part: str) -> str:
    """Occurrences, overlapping ones too: a part that can overlap itself is counted from each start."""
    if any(part[:i] == part[-i:] for i in range(1, len(part))):
        return f"len(list_filter(grams, lambda g: g = {_q(part)}))"
    return f"(len(low) - len(replace(low, {_q(part)}, ''))) / {len(part)}"


def scores(name: str, lex: Lexicon = DEFAULT) -> dict[str, str]:
    if name == "chars":
        return {k: f"greatest(0, {_chars(v)} - 2 * {_chars(lex.incompatible[k])})" if k in lex.incompatible else _chars(v) for k, v in lex.specific.items()}
    if name == "bigrams":
        return {k: f"((0 + {' + '.join(_count('low', b) for b in v)}) / greatest(1, len(x)) * 100)" for k, v in lex.bigrams.items()}
    if name == "trigrams":
        return {k: f"((0 + {' + '.join(_positions(t) for t in v)}) / greatest(1, windows) * 100)" for k, v in lex.trigrams.items()}
    if name == "words":
        return {k: f"((0 + {' + '.join(f'{n} * ' + _count('spaced', f' {w} ') for w, n in v)}) / greatest(1, n_words) * 100)" for k, v in lex.words.items()}
    if name == "keywords":
        test = lambda kw: f"regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_]){kw}([^\\p{{L}}\\p{{N}}_]|$)')" if " " in kw else f"contains(spaced, {_q(f' {kw} ')})"
        return {k: "(0 + " + " + ".join(f"case when {test(kw)} then {n} else 0 end" for kw, n in v) + ")" for k, v in lex.keywords.items()}
    return {k: _ranges(v) for k, v in lex.scripts.items()}


def _base(table: str, key: str, text: str) -> str:
    return f"""a as (select {key} as id, {text} as x, lower({text}) as low from {table}),
    b as (select *, ' ' || regexp_replace(low, '[^\\p{{L}}\\p{{N}}_]+', '  ', 'g') || ' ' as spaced, list_filter(string_split_regex(low, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '') as ws from a),
    c as (select *, len(ws) as n_words, list_sum(list_transform(ws, lambda w: greatest(0, len(w) - 2))) as windows,
          flatten(list_transform(ws, lambda w: list_transform(generate_series(1, greatest(0, len(w) - 2)), lambda i: w[i:i + 2]))) as grams from b)"""


def feature_sql(name: str, lex: Lexicon = DEFAULT, text: str = "text") -> str:
    rows = ", ".join(f"{{'lang': {_q(k)}, 'score': cast({v} as double)}}" for k, v in scores(name, lex).items())
    keep = "true" if name in ("bigrams", "keywords") else "s.score > 0"
    return f"with {_base('documents', 'doc_id', text)}, s as (select id, unnest([{rows}]) as s from c) select id as doc_id, s.lang as lang, round(s.score, 6) as score from s where {keep}"


def _east() -> tuple[str, str, str]:
    n = lambda lo, hi: _ranges([(lo, hi)])
    hira, kata, han = n(0x3040, 0x309F), n(0x30A0, 0x30FF), n(0x4E00, 0x9FFF)
    hangul, jamo = n(0xAC00, 0xD7AF), n(0x1100, 0x11FF)
    ja = f"(case when {hira} + {kata} = 0 then 0.0 else {hira} * 2 + {kata} * 1.5 + {han} * 0.5 + {_chars(L.JAPANESE_PUNCTUATION)} * 0.5 end)"
    zh = f"(case when {hira} + {kata} > 0 then 0.0 else {han} + {_chars(L.CHINESE_PUNCTUATION)} * 0.5 end)"
    ko = f"(case when {hangul} + {jamo} = 0 then 0.0 else {hangul} * 2 + {jamo} * 1.5 + {_chars(L.KOREAN_PUNCTUATION)} * 0.5 end)"
    return ja, zh, ko


_LATIN = "not regexp_matches(regexp_replace(x, '[\\x{0}-\\x{52F}\\x{1E00}-\\x{1EFF}]', '', 'g'), '\\p{L}')"


def script_sql(table: str = "pages", key: str = "page_id", text: str = "html") -> str:
    ja, zh, ko = _east()
    return f"with a as (select {key}, {text} as x from {table}) select {key}, cast({ja} as double) as japanese, cast({zh} as double) as chinese, cast({ko} as double) as korean, {_LATIN} as latin from a"


def decide_sql(compat: bool = True, lex: Lexicon = DEFAULT, text: str = "text") -> str:
    lex = lex if compat else lex.without_latin_scripts()
    has = lambda *p: f"regexp_matches(low, '{'|'.join(p)}')"
    own = lambda k: _any(lex.specific[k])
    patterns = {
        "de": f"({_any('ß')} or {has('ch')}) and {own('de')}", "fr": f"{_any('çÇ')} or {has('eau', 'aux')}", "es": f"{_any('ñÑ¿¡')} or {has('ll', 'rr')}", "it": f"{has('cch', 'zz')} and {own('it')}",
        "pt": f"{_any('ãõÃÕ')} or {has('ção')}", "sv": _any("åÅ"), "no": f"{has('og', 'på')} and {own('no')}", "da": f"{has('og', 'af')} and {own('da')}", "fi": f"{has('aa', 'ii')} and {own('fi')}",
        "nl": f"{has('ij', 'sch')} and {own('nl')}", "ro": f"{has('ul')} or {_any('șț')}", "is": _any("þÞ"), "cs": _any("řěďťňšžč"), "hu": _any("őű"), "tr": _any("ıİğ"), "pl": _any("łńśźż"),
        "id": has("yang", "dan", "untuk", "dengan", "dari", "universitas", "indonesia"), "ja": "regexp_matches(x, '[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}]')",
    }
    boosts = {
        "pt": _any("ãõÃÕ"), "es": _any("ñÑ"), "no": f"{_any('åÅ')} and {_any('æøÆØ')} and {has('på')}", "da": f"{_any('åÅ')} and {_any('æøÆØ')} and not {has('på')}", "sv": f"{_any('åÅ')} and not {_any('æøÆØ')}",
        "hu": _any("őűŐŰ"), "cs": _any("řěďťňŘĚĎŤŇ"), "pl": _any("łńśźżŁŃŚŹŻ"), "tr": _any("ıİğĞ"), "ro": _any("șțȘȚ"), "is": _any("þÞðÐ"), "de": _any("ß"),
        "id": has("indonesia", "universitas", "depok", "jakarta"), "nl": f"{has('ij')} and {has('universiteit', 'nederland', 'amsterdam')}",
    }
    chars, bi, tri, words, kws = (scores(n, lex) for n in ("chars", "bigrams", "trigrams", "words", "keywords"))
    langs = list(dict.fromkeys([*bi, *chars, *tri, *words, *kws, *patterns, *boosts]))
    columns, rows = [], []
    for k in langs:
        parts = [f"case when ch_{k} > 0 then ch_{k} * 2 else 0 end"] if k in chars else []
        parts += [f"{t[k]} * {w}" for t, w in ((bi, 1), (tri, 1.5), (words, 10), (kws, 2.5)) if k in t]
        parts += [f"case when {patterns[k]} then 50 else 0 end"] if k in patterns else []
        parts += [f"case when {boosts[k]} then 75 else 0 end"] if k in boosts else []
        columns.append(f"{' + '.join(['cast(' + parts[0] + ' as double)', *parts[1:]])} as sc_{k}")
        late = 1000 + langs.index(k)
        order = f"case when ch_{k} > 0 then {list(chars).index(k)} else {late} end" if k in chars else str(late)
        always = "true" if k in bi or k in kws else f"sc_{k} > 0"
        rows.append(f"case when {always} then {{'score': sc_{k}, 'ord': -({order}), 'lang': {_q(k)}}} end")
    scripts = scores("scripts", lex)
    best = ", ".join(f"{{'score': {v}, 'ord': {-i}, 'lang': {_q(k)}}}" for i, (k, v) in enumerate(scripts.items()))
    ja, zh, ko = _east()
    cyrillic, arabic, persian = _ranges([(0x0400, 0x04FF)]), _ranges([(0x0600, 0x06FF), (0x0750, 0x077F)]), _ranges([(0x0600, 0x06FF), (0xFB50, 0xFDFF), (0x0750, 0x077F)])
    top = lambda rows: f"(list_sort(list_filter([{rows}], lambda r: r is not null and r.score > -1), 'DESC')[1]).lang"
    return f"""with {_base('documents', 'doc_id', f'nfc_normalize({text})')},
    d as (select *, {', '.join(f'{v} as ch_{k}' for k, v in chars.items())}, list_sort(list_filter([{best}], lambda r: r.score > 0), 'DESC') as sc from c),
    e as (select *, {', '.join(columns)} from d)
    select id as doc_id, case when x is null or regexp_replace(x, '\\s+', '', 'g') = '' then 'en' when regexp_matches(x, '^[\\x{{0}}-\\x{{40}}\\x{{5B}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]*$') then 'en'
      when {ja} > 0 then 'ja' when {ko} > 0 then 'ko' when {zh} > 0 then 'zh'
      when {cyrillic} > 0 and {_any(lex.specific['uk'])} then 'uk' when {cyrillic} > 0 and {_any(lex.specific['bg'])} then 'bg' when {cyrillic} > 0 then 'ru'
      when {persian} > 0 and {_any(lex.specific['fa'])} then 'fa' when {arabic} > 0 then 'ar'
      when len(sc) > 0 then sc[1].lang when {_LATIN} then coalesce({top(', '.join(rows))}, 'en') else 'en' end as language from e"""
