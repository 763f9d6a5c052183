"""Tables of the language heuristics.

Fixed values: results depend on each of them and on their order, so they are stated as they are.
"""

# characters that count for a language
SPECIFIC_CHARS = {
    "es": "áéíñóúüÁÉÍÑÓÚÜ¿¡",
    "fr": "àâæçéèêëîïôœùûüÿÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ",
    "de": "äöüßÄÖÜ",
    "pt": "áàâãçéêíóôõúÁÀÂÃÇÉÊÍÓÔÕÚ",
    "it": "àèéìíîòóùúÀÈÉÌÍÎÒÓÙÚ",
    "ca": "àçèéíïòóúüÀÇÈÉÍÏÒÓÚÜ·",
    "nl": "áéëíóúüïèêÁÉËÍÓÚÜÏÈÊ",
    "ro": "ăâîșțĂÂÎȘȚ",
    "sv": "åäöÅÄÖ",
    "da": "åæøÅÆØ",
    "fi": "äöÄÖ",
    "is": "áðéíóúýþæöÁÐÉÍÓÚÝÞÆÖ",
    "pl": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ",
    "cs": "čďěňřšťůžČĎĚŇŘŠŤŮŽ",
    "hu": "őűŐŰ",
    "tr": "çğıİöşüÇĞÖŞÜ",
    "uk": "їієґЇІЄҐ",
    "bg": "ъьЪЬ",
    "fa": "پچژگ",
    "no": "åæøÅÆØ",
    "id": "",
}

# characters that count double against a language
INCOMPATIBLE_CHARS = {
    "es": "àÀèÈùÙìÌâÂêÊîÎôÔûÛëËïÏœŒæÆ",
    "fr": "ñÑßẞøØğĞıİčČśŚžŽłŁãÃõÕ",
    "de": "ñÑéèêëáàâãäåçîïìíóòôõúùûœŒæÆ",
    "pt": "ñÑßẞéèêëîïìíóòôùúûüœŒ",
    "it": "ñÑßẞäÄëËïÏöÖüÜæÆøØœŒãÃõÕ",
    "ca": "ñÑêÊôÔâÂïÏîÎûÛãÃõÕœŒæÆ",
    "nl": "ñÑßẞøØæÆàÀèÈìÌòÒùÙ",
    "ro": "ñÑßẞæÆøØìÌùÙ",
    "sv": "ñÑßẞæÆœŒ",
    "da": "ñÑßẞœŒ",
    "fi": "ñÑßẞæÆøØœŒ",
    "is": "ñÑßẞæÆœŒ",
    "pl": "ñÑßẞæÆøØœŒâÂêÊîÎôÔûÛ",
    "cs": "ñÑßẞæÆøØœŒ",
    "hu": "ñÑßẞæÆøØœŒ",
    "tr": "ñÑßẞæÆøØœŒ",
    "no": "ñÑßẞœŒ",
    "id": "äÄëËïÏöÖüÜæÆøØñÑßẞœŒ",
}

BIGRAMS = {
    "en": ["th", "he", "in", "er", "an", "ed", "on", "re", "at", "es"],
    "de": ["ch", "ei", "ie", "sc", "en", "er", "in", "nd", "te", "st"],
    "fr": ["ai", "es", "le", "ou", "qu", "en", "on", "nt", "re", "de"],
    "es": ["de", "en", "qu", "er", "es", "ar", "la", "os", "el", "ue"],
    "it": ["ch", "di", "la", "co", "to", "ri", "ti", "er", "in", "no"],
    "pt": ["de", "ar", "os", "qu", "er", "es", "do", "da", "ão", "en"],
    "nl": ["en", "de", "er", "ee", "ij", "aa", "an", "ge", "ie", "te"],
    "sv": ["en", "er", "et", "ar", "de", "an", "tt", "om", "på", "fö"],
    "no": ["en", "er", "et", "de", "om", "ar", "st", "og", "på", "il"],
    "da": ["en", "er", "et", "de", "ar", "st", "fo", "og", "at", "af"],
    "fi": ["in", "en", "si", "is", "an", "ss", "aa", "ll", "ui", "tä"],
    "pl": ["ie", "ni", "cz", "rz", "pr", "zy", "po", "na", "sz", "ow"],
    "cs": ["vá", "st", "ní", "ro", "po", "je", "né", "př", "ho", "sk"],
    "hu": ["sz", "el", "gy", "en", "eg", "na", "es", "et", "ek", "le"],
    "tr": ["ar", "in", "er", "en", "an", "le", "bi", "ir", "ün", "ka"],
    "ro": ["ul", "in", "er", "ar", "nt", "re", "at", "de", "la", "și"],
    "id": ["ng", "an", "en", "me", "er", "ka", "di", "in", "be", "se"],
}

TRIGRAMS = {
    "en": ["the", "and", "ing", "ion", "ent", "ati", "for", "her", "ter", "hat"],
    "es": ["ión", "ent", "que", "ade", "aci", "est", "con", "ien", "tra", "por"],
    "id": ["ang", "men", "eng", "kan", "ber", "ara", "nga", "yan", "ter", "ata"],
    "ja": ["のア", "のサ", "した", "ます", "てい", "たち", "です", "する", "いる", "れる"],
    "nl": ["een", "van", "sch", "ing", "ver", "oor", "aan", "den", "nde", "eer"],
    "fr": ["ent", "ion", "que", "les", "ati", "our", "ait", "ans", "ant", "lle"],
    "de": ["ein", "sch", "die", "und", "der", "che", "ung", "eit", "ich", "gen"],
    "it": ["ent", "one", "che", "del", "ato", "con", "are", "ell", "lla", "ion"],
    "pt": ["ent", "çao", "ção", "nto", "ade", "com", "ara", "est", "que", "ito"],
}

# words and their weights
FUNCTION_WORDS = {
    "en": {"the": 10, "of": 9, "and": 9, "to": 8, "in": 8, "for": 7, "at": 7, "with": 6, "by": 6, "from": 5, "as": 5, "on": 5, "this": 4, "that": 4},
    "es": {"el": 10, "la": 10, "los": 9, "las": 9, "de": 9, "en": 8, "y": 8, "a": 8, "que": 7, "por": 7, "con": 7, "para": 6, "un": 6, "una": 6, "se": 5, "del": 5},
    "id": {"yang": 10, "dan": 9, "di": 9, "ke": 8, "pada": 8, "untuk": 7, "dengan": 7, "dari": 7, "ini": 6, "itu": 6, "oleh": 5, "atau": 5, "tidak": 4, "dalam": 4},
    "ja": {"の": 10, "に": 9, "は": 9, "を": 8, "が": 8, "と": 7, "で": 7, "から": 6, "より": 6, "まで": 5, "など": 5, "による": 4, "において": 4},
    "nl": {"de": 10, "het": 10, "een": 9, "en": 9, "van": 9, "in": 8, "op": 8, "voor": 7, "met": 7, "door": 6, "aan": 6, "bij": 5, "als": 5, "uit": 4, "over": 4},
    "fr": {"le": 10, "la": 10, "les": 9, "de": 9, "à": 8, "des": 8, "et": 8, "en": 7, "un": 7, "une": 6, "du": 6, "par": 5, "pour": 5, "avec": 4, "sur": 4},
    "de": {"der": 10, "die": 10, "das": 9, "und": 9, "in": 8, "von": 8, "mit": 7, "für": 7, "auf": 6, "zu": 6, "aus": 5, "bei": 5, "nach": 4, "über": 4},
}

# keywords and their weights
ACADEMIC_KEYWORDS = {
    "fr": {
        "université": 10, "école": 8, "institut": 9, "laboratoire": 8, "recherche": 7, "france": 6, "collège": 5, "école normale": 5, "centre de recherche": 7, "sciences": 4,
        "arts": 3, "médecine": 2, "faculté": 6, "département": 5, "sorbonne": 8, "enseignement": 4, "étude": 3, "académie": 5,
    },
    "es": {
        "universidad": 10, "instituto": 9, "investigaciones": 8, "autónoma": 7, "politécnica": 6, "departamento": 5, "españa": 5, "facultad": 4, "escuela": 3,
        "centro de investigación": 6, "escuela técnica": 4, "ciencias": 3, "tecnología": 6, "ingeniería": 5, "estudios": 5, "colegio": 4, "academia": 4,
    },
    "id": {
        "universitas": 10, "indonesia": 9, "institut": 8, "penelitian": 7, "fakultas": 6, "pusat": 5, "teknologi": 5, "departemen": 4, "ilmu": 4, "jakarta": 3, "bandung": 3,
        "laboratorium": 9, "teknik": 5, "studi": 5, "sekolah": 5, "perguruan": 4, "akademi": 4,
    },
    "ja": {"大学": 10, "研究所": 9, "東京": 9, "日本": 9, "学部": 7, "学院": 6, "センター": 6, "研究センター": 7, "実験室": 9, "学科": 8, "科学": 6, "技術": 6, "工学": 5, "研究科": 5, "学校": 5, "アカデミー": 4},
    "nl": {
        "universiteit": 10, "nederland": 9, "faculteit": 7, "instituut": 8, "centrum": 6, "onderzoek": 5, "technische": 7, "school": 5, "academie": 6, "laboratorium": 9,
        "afdeling": 8, "wetenschap": 6, "technologie": 6, "techniek": 5, "studie": 5, "hogeschool": 4, "amsterdam": 8, "leiden": 8, "utrecht": 8, "nijmegen": 8,
    },
    "en": {
        "university": 10, "college": 9, "institute": 8, "center": 7, "research": 6, "school": 5, "uk": 6, "usa": 6, "canada": 6, "department": 5, "faculty": 6, "academy": 5,
        "institute of technology": 7, "institute of science": 6, "laboratory": 9, "science": 6, "technology": 6, "engineering": 5, "studies": 5,
    },
    "de": {
        "universität": 10, "hochschule": 9, "fraunhofer": 8, "technische": 8, "deutschland": 7, "akademie": 7, "institut": 6, "forschungszentrum": 6, "schule": 5,
        "wissenschaften": 6, "medizinfakultät": 4, "berlin": 8, "münchen": 8,
    },
    "it": {
        "università": 10, "dipartimento": 9, "italia": 8, "scuola": 7, "istituto": 8, "centro di ricerca": 6, "facoltà": 5, "politecnico": 7, "accademia": 6, "scienze": 4,
        "arte": 3, "roma": 8, "milano": 8, "torino": 8,
    },
    "pt": {
        "universidade": 10, "brasil": 9, "portugal": 9, "instituto": 8, "faculdade": 7, "departamento": 6, "escola": 5, "centro de pesquisa": 6, "tecnologia": 5,
        "ciências": 3, "são paulo": 8, "rio de janeiro": 8, "lisboa": 8,
    },
}

# code point ranges
SCRIPT_RANGES = {
    "ru": [(0x0400, 0x04FF)],
    "uk": [(0x0400, 0x04FF)],
    "bg": [(0x0400, 0x04FF)],
    "el": [(0x0370, 0x03FF)],
    "pl": [(0x0100, 0x024F)],
    "cs": [(0x0100, 0x024F)],
    "hu": [(0x0100, 0x024F)],
    "tr": [(0x0100, 0x024F)],
    "ar": [(0x0600, 0x06FF), (0x0750, 0x077F)],
    "he": [(0x0590, 0x05FF)],
    "fa": [(0x0600, 0x06FF), (0xFB50, 0xFDFF), (0x0750, 0x077F)],
    "zh": [(0x4E00, 0x9FFF), (0x3400, 0x4DBF)],
    "ja": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF00, 0xFFEF), (0x4E00, 0x9FFF)],
    "ko": [(0xAC00, 0xD7AF), (0x1100, 0x11FF)],
    "hi": [(0x0900, 0x097F)],
    "bn": [(0x0980, 0x09FF)],
    "ta": [(0x0B80, 0x0BFF)],
    "te": [(0x0C00, 0x0C7F)],
    "kn": [(0x0C80, 0x0CFF)],
    "ml": [(0x0D00, 0x0D7F)],
    "th": [(0x0E00, 0x0E7F)],
    "km": [(0x1780, 0x17FF)],
    "my": [(0x1000, 0x109F)],
    "lo": [(0x0E80, 0x0EFF)],
    "am": [(0x1200, 0x137F)],
    "ka": [(0x10A0, 0x10FF)],
    "hy": [(0x0530, 0x058F)],
}

# the four Latin scripts whose range hides the scores of other languages; left out unless `compat`
LATIN_SCRIPTS = ("pl", "cs", "hu", "tr")

JAPANESE_PUNCTUATION = "、。「」『』・"
CHINESE_PUNCTUATION = '，。："；？！（）'
KOREAN_PUNCTUATION = "…·"

# languages that are translated before entities are looked for
TRANSLATED_LANGUAGES = [
    "zh", "ja", "ko", "ar", "ru", "fa", "uk", "bg", "sr", "mk", "ka", "hy", "he", "th", "hi", "bn", "ta", "te", "ml", "kn", "my", "km", "lo", "si", "am", "el",
]

# first level of organisation type and the prefix of its second level
ORG_TYPE_PREFIX = {
    "Company": "PRC.",
    "Healthcare": "HEA.",
    "Higher Education": "HEI.",
    "Individual": "Individual",
    "Other": "OTH.",
    "Primary and Secondary Education": "EDU.",
    "Public Administration": "PUB.",
    "Research Organization": "REC.",
    "Unknown": "Unknown",
}

# country and search region
SEARCH_REGION = {
    "united kingdom": "uk-en", "united states": "us-en", "france": "fr-fr", "germany": "de-de", "spain": "es-es", "italy": "it-it", "netherlands": "nl-nl",
    "belgium": "be-nl", "portugal": "pt-pt", "poland": "pl-pl", "sweden": "se-sv", "norway": "no-no", "denmark": "dk-da", "finland": "fi-fi", "austria": "at-de",
    "switzerland": "ch-de", "ireland": "ie-en", "czech republic": "cz-cs", "czechia": "cz-cs", "australia": "au-en", "canada": "ca-en", "new zealand": "nz-en",
    "japan": "jp-jp", "south korea": "kr-kr", "china": "cn-zh", "india": "in-en", "brazil": "br-pt", "mexico": "mx-es", "argentina": "ar-es", "turkey": "tr-tr",
    "türkiye": "tr-tr", "russia": "ru-ru", "israel": "il-he", "south africa": "za-en", "singapore": "sg-en", "malaysia": "my-en", "thailand": "th-th",
    "indonesia": "id-en", "philippines": "ph-en", "greece": "gr-el", "romania": "ro-ro", "hungary": "hu-hu", "croatia": "hr-hr", "slovenia": "si-sl",
    "slovakia": "sk-sk", "bulgaria": "bg-bg", "serbia": "rs-sr", "ukraine": "ua-uk", "estonia": "ee-et", "latvia": "lv-lv", "lithuania": "lt-lt",
}
DEFAULT_SEARCH_REGION = "wt-wt"
