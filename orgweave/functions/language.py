"""Language heuristics as column expressions: no shuffle. All parts of words, characters and ranges that the tables name are counted in one Arrow call per text, from
histograms of its characters and of its pairs and triples of them, as a pass of the text for each costs many times as much; everything else stays with the JVM.

Every feature is an array of struct(lang, score) in the order of its table, so one explode gives the long form. The tables
can be extended at run time by passing a changed `Lexicon`.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweave.functions import lexicons as L
from orgweave.functions.text import compose, language_base
from orgweave.plans.settle import small_batches


@dataclass(frozen=True)
class Lexicon:
    specific: dict[str, str] = field(default_factory=lambda: dict(L.SPECIFIC_CHARS))
    incompatible: dict[str, str] = field(default_factory=lambda: dict(L.INCOMPATIBLE_CHARS))
    bigrams: dict[str, list[str]] = field(default_factory=lambda: dict(L.BIGRAMS))
    trigrams: dict[str, list[str]] = field(default_factory=lambda: dict(L.TRIGRAMS))
    words: dict[str, list[tuple[str, int]]] = field(default_factory=lambda: {k: list(v.items()) for k, v in L.FUNCTION_WORDS.items()})
    keywords: dict[str, list[tuple[str, int]]] = field(default_factory=lambda: {k: list(v.items()) for k, v in L.ACADEMIC_KEYWORDS.items()})
    scripts: dict[str, list[tuple[int, int]]] = field(default_factory=lambda: dict(L.SCRIPT_RANGES))

    def register(self, code: str, *, specific: str = "", incompatible: str = "", bigrams=(), trigrams=(), words=None, keywords=None, scripts=()) -> "Lexicon":
        """A lexicon with one more language (or one changed)."""
        out = replace(self)
        for name, value in (("specific", specific), ("incompatible", incompatible), ("bigrams", list(bigrams)), ("trigrams", list(trigrams)), ("words", list((words or {}).items())), ("keywords", list((keywords or {}).items())), ("scripts", list(scripts))):
            if value:
                object.__setattr__(out, name, getattr(self, name) | {code: value})
        return out

    def without_latin_scripts(self) -> "Lexicon":
        return replace(self, scripts={k: v for k, v in self.scripts.items() if k not in L.LATIN_SCRIPTS})


DEFAULT = Lexicon()


#: Ways to count a part: its occurrences one after the other, overlapping ones too, as a whole word, whether it is such a word, is words that stand somewhere, is there (0 or 1).
_PLAIN, _LAPPING, _WORD, _IS_WORD, _PHRASE, _THERE = "plain", "lapping", "word", "is word", "phrase", "there"
_EDGE = r"[^\p{L}\p{N}_]"
_LENGTH, _WORDS, _WINDOWS = ("length",), ("words",), ("windows",)


def _laps(part: str) -> bool:
    """Whether occurrences of the part can overlap."""
    return any(part[:i] == part[-i:] for i in range(1, len(part)))


class _Characters:
    """Counts of sets of characters from one histogram of a text. Each set is a tuple of ranges; a character in two ranges of a set counts twice.

    Characters that no set tells apart share a class, so the histogram is as wide as the sets have edges.
    """

    def __init__(self, sets: list[tuple[tuple[int, int], ...]]):
        edges = sorted({e for ranges in sets for lo, hi in ranges for e in (lo, hi + 1)})
        self.of = np.searchsorted(edges, np.arange(min(max(edges, default=0), 0x10FFFF) + 1), "right").astype(np.uint16)
        firsts = [-1, *edges]
        self.size = len(firsts)
        self.sums = np.array([[sum(lo <= c <= hi for lo, hi in ranges) for ranges in sets] for c in firsts], np.float64).reshape(self.size, len(sets))

    def histogram(self, codes: np.ndarray) -> np.ndarray:
        return np.bincount(self.of.take(codes, mode="clip"), minlength=self.size)


class _Grams:
    """Counts of parts of two and three characters at every start, all from one walk over a text."""

    def __init__(self, parts: list[str]):
        letters = sorted({ord(c) for p in parts for c in p})
        self.width = len(letters) + 1
        self.of = np.zeros(max(letters, default=0) + 2, np.int32)
        self.of[letters] = np.arange(1, self.width)
        self.pairs, self.starts = np.zeros(self.width**2, np.int16), np.zeros(self.width**2, np.int32)
        pair = lambda p: int(self.of[ord(p[0])]) * self.width + int(self.of[ord(p[1])])
        three = [p for p in parts if len(p) == 3]
        firsts = {k: i for i, k in enumerate(dict.fromkeys(pair(p) for p in three), 1)}
        self.threes = np.zeros((len(firsts) + 1) * self.width, np.int16)
        for k, i in firsts.items():
            self.starts[k] = i * self.width
        for i, p in enumerate(parts, 1):
            if len(p) == 2:
                self.pairs[pair(p)] = i
            else:
                self.threes[firsts[pair(p)] * self.width + int(self.of[ord(p[2])])] = i
        self.size = len(parts) + 1

    def counts(self, codes: np.ndarray) -> np.ndarray:
        at = self.of.take(codes, mode="clip")
        pairs = at[:-1] * self.width + at[1:]
        out = np.bincount(self.pairs.take(pairs), minlength=self.size)
        if len(at) > 2:
            out += np.bincount(self.threes.take(self.starts.take(pairs[:-1]) + at[2:]), minlength=self.size)
        return out[1:]


@lru_cache(maxsize=16)
def _counting(keys: tuple[tuple, ...]):
    """(text, it in small letters) → the counts that the keys of a view ask for, of a batch: texts × keys."""
    sets = [k[1] for k in keys if k[0] == "characters"]
    characters = _Characters(sets)
    forms = [k[1] for k in keys if k[0] == "parts"]
    parts = list(dict.fromkeys((way, part) for form in forms for way, part, _ in form))
    at_starts = [(way, p) for way, p in parts if len(p) in (2, 3) and (way == _LAPPING or way == _PLAIN and not _laps(p))]
    grams = _Grams([p for _, p in at_starts])
    # whole words are looked up from the text's own words, which are few, and not from the tables', which are hundreds
    whole = [(way, p) for way, p in parts if way in (_WORD, _IS_WORD)]
    others = [x for x in parts if x not in set(at_starts) and x not in set(whole)]
    place = {x: i for i, x in enumerate([*at_starts, *others, *whole])}
    counted, there = ({p: place[way, p] for way, p in whole if way == kind} for kind in (_WORD, _IS_WORD))
    others_to = len(at_starts) + len(others)
    weights = np.zeros((len(place), len(forms)))
    for j, form in enumerate(forms):
        for way, part, weight in form:
            weights[place[way, part], j] += weight
    column = {k: i for i, k in enumerate(keys)}
    word = re.compile(r"\w+")

    def other(low: str, way: str, part: str) -> int:
        if way == _PLAIN:
            return low.count(part)
        if way == _LAPPING:
            return sum(low.startswith(part, i) for i in range(len(low)))
        if way == _THERE:
            return int(part in low)
        return int(part in low and regex.search(f"(^|{_EDGE}){regex.escape(part)}({_EDGE}|$)", low) is not None)

    def run(texts, lows) -> np.ndarray:
        out = np.zeros((len(texts), len(keys)))
        histograms, found = np.zeros((len(texts), characters.size)), np.zeros((len(texts), len(place)))
        for i, (text, low) in enumerate(zip(texts, lows, strict=True)):
            x = text.as_py()
            if _LENGTH in column:
                out[i, column[_LENGTH]] = len(x)
            if sets:
                histograms[i] = characters.histogram(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32))
            low = low.as_py() if low is not None else ""
            if _WORDS in column or _WINDOWS in column or whole:
                words = word.findall(low)
                if whole:
                    for w, n in Counter(words).items():
                        if w in counted:
                            found[i, counted[w]] = n
                        if w in there:
                            found[i, there[w]] = 1
                if _WORDS in column:
                    out[i, column[_WORDS]] = len(words)
                if _WINDOWS in column:
                    out[i, column[_WINDOWS]] = sum([len(w) - 2 for w in words if len(w) > 2])
            if at_starts and len(low) > 1:
                found[i, : len(at_starts)] = grams.counts(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32))
            if others:
                found[i, len(at_starts) : others_to] = [other(low, way, part) for way, part in others]
        if sets:
            out[:, [i for k, i in column.items() if k[0] == "characters"]] = histograms @ characters.sums
        if forms:
            out[:, [i for k, i in column.items() if k[0] == "parts"]] = found @ weights
        return out

    return run


def _counter(keys: tuple[tuple, ...]):
    """An Arrow function (text, it in small letters) → array<int> of what the keys ask for. No more than one text at a time is held as a Python string."""

    def counted(x: pa.Array, low: "pa.Array | None" = None) -> pa.Array:
        known = np.asarray(x.is_valid())
        mine = x.filter(pa.array(known))
        values = _counting(keys)(mine, low.filter(pa.array(known)) if low is not None else [None] * len(mine))
        ends = np.concatenate([[0], np.cumsum(known) * len(keys)]).astype(np.int32)
        # (a list whose offset is null is null, and has no values)
        offsets = pa.array(ends, pa.int32(), mask=np.concatenate([~known, [False]]))
        return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32).ravel()))

    if not any(k[0] in ("words", "windows", "parts") for k in keys):
        return F.arrow_udf(lambda x: counted(x), "array<int>")
    return F.arrow_udf(lambda x, low: counted(x, low), "array<int>")


def _trigram_part(g: str) -> tuple[str, str]:
    return (_LAPPING if _laps(g) else _PLAIN), g


def _keyword_part(kw: str) -> tuple[str, str]:
    return (_PHRASE if " " in kw else _IS_WORD), kw


@dataclass(frozen=True)
class _View:
    """What the features read of a text, counted once per row. What they ask for is noted in `keys`."""

    x: Column  # the text
    counts: Column  # of each key
    keys: dict[tuple, int]

    def _get(self, key: tuple) -> Column:
        return F.get(self.counts, F.lit(self.keys.setdefault(key, len(self.keys))))

    @property
    def length(self) -> Column:
        return self._get(_LENGTH)

    @property
    def words(self) -> Column:
        return self._get(_WORDS)

    @property
    def windows(self) -> Column:
        """Three-letter windows inside words."""
        return self._get(_WINDOWS)

    def weighed(self, *parts: tuple[str, str, int]) -> Column:
        """The sum of weight × count of each (way, part, weight)."""
        return self._get(("parts", parts)) if parts else F.lit(0)

    def characters(self, ranges: list[tuple[int, int]]) -> Column:
        """Characters in the ranges; one in two ranges counts twice."""
        return self._get(("characters", tuple(ranges))) if ranges else F.lit(0)

    def there(self, *parts: str) -> Column:
        """Whether one of the parts is in the text."""
        return self.weighed(*[(_THERE, p, 1) for p in parts]) > 0


def _viewing(x: Column, body) -> Column:
    """`body` of a text's view. A lambda binds the view, as an expression this large would compute it anew for each use."""
    keys: dict[tuple, int] = {}
    body(_View(F.col("x"), F.col("counts"), keys))  # to learn what is to be counted
    asked = tuple(keys)
    small_batches(SparkSession.active())
    counted = _counter(asked)
    counts = counted(x, F.lower(x)) if any(k[0] in ("words", "windows", "parts") for k in asked) else counted(x)
    return F.get(F.transform(F.array(F.struct(x.alias("x"), counts.alias("counts"))), lambda t: body(_View(t["x"], t["counts"], keys))), F.lit(0))


def _array(scores: list[tuple[str, Column]], keep_zero: bool) -> Column:
    out = F.array(*[F.struct(F.lit(lang).alias("lang"), score.cast("double").alias("score")) for lang, score in scores])
    return out if keep_zero else F.filter(out, lambda s: s["score"] > 0)


def _chars(v: _View, chars: str) -> Column:
    """Occurrences of the characters."""
    return v.characters([(c, c) for c in sorted(map(ord, set(chars)))])


def _any(v: _View, chars: str) -> Column:
    return _chars(v, chars) > 0


def char_scores(v: _View, lex: Lexicon = DEFAULT) -> list[tuple[str, Column]]:
    out = []
    for lang, chars in lex.specific.items():
        n = _chars(v, chars)
        if lang in lex.incompatible:
            n = F.greatest(F.lit(0), n - 2 * _chars(v, lex.incompatible[lang]))
        out.append((lang, n))
    return out


def bigram_scores(v: _View, lex: Lexicon = DEFAULT) -> list[tuple[str, Column]]:
    return [(lang, v.weighed(*[(_PLAIN, b, 1) for b in grams]) / F.greatest(F.lit(1), v.length) * 100) for lang, grams in lex.bigrams.items()]


def trigram_scores(v: _View, lex: Lexicon = DEFAULT) -> list[tuple[str, Column]]:
    """Occurrences, overlapping ones too, per 100 three-letter windows inside words."""
    return [(lang, v.weighed(*[(*_trigram_part(g), 1) for g in grams]) / F.greatest(F.lit(1), v.windows) * 100) for lang, grams in lex.trigrams.items()]


def word_scores(v: _View, lex: Lexicon = DEFAULT) -> list[tuple[str, Column]]:
    n = F.greatest(F.lit(1), v.words)
    return [(lang, v.weighed(*[(_WORD, word, w) for word, w in words]) / n * 100) for lang, words in lex.words.items()]


def keyword_scores(v: _View, lex: Lexicon = DEFAULT) -> list[tuple[str, Column]]:
    return [(lang, v.weighed(*[(*_keyword_part(kw), w) for kw, w in kws])) for lang, kws in lex.keywords.items()]


def script_scores(v: _View, lex: Lexicon = DEFAULT) -> list[tuple[str, Column]]:
    return [(lang, v.characters(ranges)) for lang, ranges in lex.scripts.items()]


FEATURES = {
    "chars": (char_scores, False),
    "bigrams": (bigram_scores, True),
    "trigrams": (trigram_scores, False),
    "words": (word_scores, False),
    "keywords": (keyword_scores, True),
    "scripts": (script_scores, False),
}


def feature(name: str, x: Column, lex: Lexicon = DEFAULT) -> Column:
    """array<struct(lang, score)>; chars, trigrams, words and scripts leave zeros out."""
    scores, keep_zero = FEATURES[name]
    return _viewing(x, lambda v: _array(scores(v, lex), keep_zero))


def _n(v: _View, lo: int, hi: int) -> Column:
    return v.characters([(lo, hi)])


def _japanese(v: _View) -> Column:
    hiragana, katakana = _n(v, 0x3040, 0x309F), _n(v, 0x30A0, 0x30FF)
    score = hiragana * 2 + katakana * 1.5 + _n(v, 0x4E00, 0x9FFF) * 0.5 + _chars(v, L.JAPANESE_PUNCTUATION) * 0.5
    return F.when(_n(v, 0x3040, 0x30FF) == 0, 0.0).otherwise(score)


def _chinese(v: _View) -> Column:
    return F.when(_n(v, 0x3040, 0x30FF) > 0, 0.0).otherwise(_n(v, 0x4E00, 0x9FFF) + _chars(v, L.CHINESE_PUNCTUATION) * 0.5)


def _korean(v: _View) -> Column:
    hangul, jamo = _n(v, 0xAC00, 0xD7AF), _n(v, 0x1100, 0x11FF)
    return F.when(hangul + jamo == 0, 0.0).otherwise(hangul * 2 + jamo * 1.5 + _chars(v, L.KOREAN_PUNCTUATION) * 0.5)


def japanese_score(x: Column) -> Column:
    """Kana, and beside them Han characters and punctuation; 0 without kana."""
    return _viewing(x, _japanese)


def chinese_score(x: Column) -> Column:
    """Han characters and punctuation, the ASCII double quote among it; 0 beside kana."""
    return _viewing(x, _chinese)


def korean_score(x: Column) -> Column:
    return _viewing(x, _korean)


def is_latin(x: Column) -> Column:
    return ~x.rlike(r"[\p{L}&&[^\x{0000}-\x{052F}\x{1E00}-\x{1EFF}]]")


def _patterns(v: _View, lex: Lexicon) -> dict[str, Column]:
    """Where a language's spelling habits show; 50 points each."""
    has = v.there
    own = lambda lang: _any(v, lex.specific[lang])
    return {
        "de": (_any(v, "ß") | has("ch")) & own("de"),
        "fr": _any(v, "çÇ") | has("eau", "aux"),
        "es": _any(v, "ñÑ¿¡") | has("ll", "rr"),
        "it": has("cch", "zz") & own("it"),
        "pt": _any(v, "ãõÃÕ") | has("ção"),
        "sv": _any(v, "åÅ"),
        "no": has("og", "på") & own("no"),
        "da": has("og", "af") & own("da"),
        "fi": has("aa", "ii") & own("fi"),
        "nl": has("ij", "sch") & own("nl"),
        "ro": has("ul") | _any(v, "șț"),
        "is": _any(v, "þÞ"),
        "cs": _any(v, "řěďťňšžč"),
        "hu": _any(v, "őű"),
        "tr": _any(v, "ıİğ"),
        "pl": _any(v, "łńśźż"),
        "id": has("yang", "dan", "untuk", "dengan", "dari", "universitas", "indonesia"),
        "ja": v.characters([(0x3040, 0x30FF), (0x4E00, 0x9FFF)]) > 0,
    }


def _boosts(v: _View) -> list[tuple[str, Column]]:
    """Distinctive characters and words; 75 points each."""
    has = v.there
    nordic, danish = _any(v, "åÅ"), _any(v, "æøÆØ")
    return [
        ("pt", _any(v, "ãõÃÕ")),
        ("es", _any(v, "ñÑ")),
        ("no", nordic & danish & has("på")),
        ("da", nordic & danish & ~has("på")),
        ("sv", nordic & ~danish),
        ("hu", _any(v, "őűŐŰ")),
        ("cs", _any(v, "řěďťňŘĚĎŤŇ")),
        ("pl", _any(v, "łńśźżŁŃŚŹŻ")),
        ("tr", _any(v, "ıİğĞ")),
        ("ro", _any(v, "șțȘȚ")),
        ("is", _any(v, "þÞðÐ")),
        ("de", _any(v, "ß")),
        ("id", has("indonesia", "universitas", "depok", "jakarta")),
        ("nl", has("ij") & has("universiteit", "nederland", "amsterdam")),
    ]


def latin_scores(v: _View, lex: Lexicon = DEFAULT) -> Column:
    """array<struct(score, order, lang)> of the languages that have a score at all.

    order stands for first-come precedence: languages with own characters in the text, then the bigram table, then the rest.
    """
    chars, bi, tri, words, kws = (dict(f(v, lex)) for f in (char_scores, bigram_scores, trigram_scores, word_scores, keyword_scores))
    patterns, boosts = _patterns(v, lex), dict(_boosts(v))
    langs = list(dict.fromkeys([*bi, *chars, *tri, *words, *kws, *patterns, *boosts]))
    rows = []
    for lang in langs:
        parts: list[Column] = []
        if lang in chars:
            parts.append(F.when(chars[lang] > 0, chars[lang] * 2).otherwise(0))
        for table, weight in ((bi, 1), (tri, 1.5), (words, 10), (kws, 2.5)):
            if lang in table:
                parts.append(table[lang] * weight)
        if lang in patterns:
            parts.append(F.when(patterns[lang], 50).otherwise(0))
        if lang in boosts:
            parts.append(F.when(boosts[lang], 75).otherwise(0))
        total = sum(parts[1:], parts[0].cast("double"))
        first = list(chars).index(lang) if lang in chars else None
        late = 1000 + langs.index(lang)
        order = F.when(chars[lang] > 0, first).otherwise(late) if first is not None else F.lit(late)
        always = lang in bi or lang in kws
        row = F.struct(total.alias("score"), (-order).alias("order"), F.lit(lang).alias("lang"))
        rows.append(row if always else F.when(total > 0, row))
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def decide(x: Column, default: str = "en", compat: bool = True, lex: Lexicon = DEFAULT) -> Column:
    """The language of a text in composed form. `compat` keeps the Latin script rows, which let a single letter such as `ł` or `œ` decide for Polish."""
    lex = lex if compat else lex.without_latin_scripts()
    return F.when(x.isNull() | ~x.rlike(r"(?U)\S") | x.rlike(r"^[\x00-\x7F&&[^A-Za-z]]*$"), default).otherwise(_viewing(x, lambda v: _decide(v, default, lex)))


def _decide(v: _View, default: str, lex: Lexicon) -> Column:
    # no script row reaches below U+0100, so a text without such characters has no script
    scripts = F.array(*[F.struct(n.alias("score"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")) for i, (lang, n) in enumerate(script_scores(v, lex))])
    best_script = F.array_max(F.filter(scripts, lambda s: s["score"] > 0))["lang"]
    lowest = min(lo for ranges in lex.scripts.values() for lo, _ in ranges)
    wide = _n(v, lowest, 0x10FFFF) > 0
    cyrillic = _n(v, 0x0400, 0x04FF) > 0
    arabic = v.characters([(0x0600, 0x06FF), (0x0750, 0x077F)]) > 0
    persian = v.characters([(0x0600, 0x06FF), (0x0750, 0x077F), (0xFB50, 0xFDFF)]) > 0
    latin = F.when(is_latin(F.regexp_replace(v.x, r"[\x00-\x7F]+", "")), F.coalesce(F.array_max(latin_scores(v, lex))["lang"], F.lit(default))).otherwise(default)
    by_script = (
        F.when(_japanese(v) > 0, "ja")
        .when(_korean(v) > 0, "ko")
        .when(_chinese(v) > 0, "zh")
        .when(cyrillic & _any(v, lex.specific["uk"]), "uk")
        .when(cyrillic & _any(v, lex.specific["bg"]), "bg")
        .when(cyrillic, "ru")
        .when(persian & _any(v, lex.specific["fa"]), "fa")
        .when(arabic, "ar")
        .otherwise(best_script)
    )
    return F.coalesce(F.when(wide | _any(v, '"'), by_script), latin)


def combine_with_model(heuristic: Column, first: Column, first_p: Column, second: Column, second_p: Column, name: str = "combined_langdetect") -> Column:
    """struct(language, method, confidence) from the heuristic's answer and a detector's two likeliest codes with their probabilities.

    Catalan is the detector's to say, and Dutch where the heuristic didn't say English; English and Spanish are the heuristic's. Kana decide for Japanese; Korean is only
    believed to be Chinese or Japanese, by the second code. Otherwise the detector's code stands. A null code: no answer, the heuristic's stands alone.
    """
    top, other = language_base(first), language_base(second)
    none = F.lit(None).cast("double")
    info = lambda language, method, p: F.struct(language.alias("language"), F.lit(method).alias("method"), F.bround(p, 4).alias("confidence"))
    said = lambda code: info(F.lit(code) if isinstance(code, str) else code, name, first_p)
    alone = info(heuristic, "heuristic", none)
    return (
        F.when(top.isNull(), alone)
        .when(top == "ca", said("ca"))
        .when((top == "nl") & (heuristic != "en"), said("nl"))
        .when(heuristic.isin("en", "es"), alone)
        .when(top.isin("ja", "zh", "ko") & ((top == "ja") | (heuristic == "ja")), said("ja"))
        .when(top == "zh", said("zh"))
        .when((top == "ko") & (other == "zh"), info(F.lit("zh"), name, second_p))
        .when(top == "ko", said("ja"))
        .otherwise(said(top))
    )


#: Name of a method → whether the detector is weighed against the heuristic (else it is asked where the heuristic is undecided).
METHODS = {"heuristic": False, "langdetect": False, "e5": False, "fasttext": False, "combined_langdetect": True, "combined_e5": False}


def detect(df: DataFrame, column: str, method: str = "heuristic", model=None, default: str = "en", compat: bool = True) -> DataFrame:
    """`df` plus language_info struct(language, method, confidence).

    model: DataFrame → DataFrame that adds first, first_p, second and second_p to rows of (text); called for distinct texts. Without one only the heuristic speaks.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}, not {method!r}")
    weigh = METHODS[method]
    kept = compose(df.withColumn("_nfc", F.col(column)), "_nfc")
    asks = method != "heuristic" and model is not None
    guess = decide(F.col("_nfc"), "und" if asks and not weigh else default, compat)
    info = lambda language, name, p: F.struct(language.alias("language"), F.lit(name).alias("method"), p.cast("double").alias("confidence"))
    if not asks:
        return kept.withColumn("language_info", info(guess, "heuristic", F.lit(None))).drop("_nfc")
    guessed = kept.withColumn("_guess", guess)
    texts = guessed if weigh else guessed.where("_guess = 'und'")
    answers = model(texts.select(F.col("_nfc").alias("text")).where("text is not null").distinct())
    names = {"first": "_first", "first_p": "_p", "second": "_second", "second_p": "_p2"}
    joined = guessed.join(answers.select(F.col("text").alias("_nfc"), *[F.col(k).alias(v) for k, v in names.items()]), "_nfc", "left")
    if weigh:
        out = combine_with_model(F.col("_guess"), F.col("_first"), F.col("_p"), F.col("_second"), F.col("_p2"), method)
    else:
        out = (
            F.when(F.col("_guess") != "und", info(F.col("_guess"), "heuristic", F.lit(None)))
            .when(F.col("_first").isNotNull(), info(language_base(F.col("_first")), method, F.bround("_p", 4)))
            .otherwise(info(F.lit(default), "default", F.lit(None)))
        )
    return joined.withColumn("language_info", out).drop("_nfc", "_guess", *names.values())
