"""Word lists, tables and patterns of the normalisers.

Fixed values: results depend on every one of them. They are stated as plain text, in groups.
"""

from __future__ import annotations

# Legal forms and what each is reduced to.
LEGAL_FORMS = {
    "pvt": "private", "private": "private", "prvt": "private",
    "ltd": "limited", "limited": "limited",
    "llc": "llc", "inc": "inc", "incorporated": "inc",
    "corp": "corp", "corporation": "corp", "co": "co", "company": "co",
    "llp": "llp", "lp": "lp", "pc": "pc", "pllc": "pllc", "plc": "plc", "public": "public", "opc": "opc",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "eurl": "eurl", "sa": "sa", "sci": "sci",
    "snc": "snc", "sca": "sca", "scop": "scop",
}

# Words that do not tell names apart.
HONORIFICS = ["mr", "mrs", "ms", "shri", "sri", "smt", "the"]
STOPWORDS = ["and", "of", "de", "du", "des", "la", "le", "les", "et", "d", "l"]
COUNTRY_WORDS = ["india", "france", "usa"]

# Words of addresses.
ADDRESS_NULLS = ["null", "none", "nan", "na", "no"]
ORDINAL_WORDS = {"first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8", "ninth": "9", "tenth": "10"}
STREET_WORDS = {
    "street": "st", "st": "st", "saint": "st", "road": "rd", "rd": "rd", "drive": "dr", "dr": "dr",
    "avenue": "ave", "ave": "ave", "av": "ave", "avenu": "ave", "lane": "ln", "ln": "ln",
    "court": "ct", "ct": "ct", "circle": "cir", "cir": "cir", "boulevard": "blvd", "blvd": "blvd",
    "bd": "blvd", "parkway": "pkwy", "pkwy": "pkwy", "highway": "hwy", "hwy": "hwy",
    "trail": "trl", "trl": "trl", "place": "pl", "pl": "pl", "terrace": "ter", "turnpike": "tpke",
    "tpke": "tpke", "tpk": "tpke", "suite": "ste", "ste": "ste", "apartment": "apt", "apt": "apt",
    "floor": "fl", "flr": "fl", "fl": "fl", "building": "bldg", "bldg": "bldg", "ngr": "nagar",
    "sec": "sector",
}
FRENCH_WORDS = {"r": "rue", "all": "allee", "imp": "impasse", "ch": "chemin", "fg": "faubourg", "fbg": "faubourg", "bis": "b", "rte": "route", "sq": "square"}

# Patterns, in Java's syntax. Word edges are spelled out, as \b differs by engine outside ASCII.
_L, _R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
ALIAS = rf"(?i){_L}(?:trading\s+as|t/a|a/k/a|aka|f/k/a|fka|formerly(?:\s+known\s+as)?|d/b/a|dba){_R}"
HANDLE = rf"^[\s@#]*[@#]|www\.|\.(?:com|in|net|org|fr){_R}"
WEB_ENDING = rf"\.(?:com|in|net|org|co|fr|biz|info){_R}"
DOTTED = rf"{_L}(?:[a-z]\.){{2,}}[a-z]?\.?"
TOKEN = r"[a-z0-9À-ɏ]+|[ऀ-෿]+"
INDIC = r"[ऀ-෿]"
INDIC_FIRST, INDIC_LAST = 0x900, 0xDFF
POST_BOX = rf"{_L}(?:p\s*\.?\s*o\s*\.?\s*box|post\s*box|pmb)\s*[#:.\-]?\s*\d+"
NOT_APPLICABLE = rf"{_L}n\s*/\s*a{_R}"
ORDINAL = r"^([0-9]+)(?:st|nd|rd|th)$"
NUMBER_SUFFIX = r"^([0-9]+)([a-z]+)$"
LOOKALIKE = r"^(?=(?:.*[a-z]){2})(?=.*[013457])[a-z013457]+$"
LOOKALIKE_FROM, LOOKALIKE_TO = "013457", "oleast"
ID_TAG = rf"{_L}id [0-9]+{_R}"

#: Decimal digits of the scripts in INDIC, block by block, and the ASCII digits they stand for.
INDIC_DIGITS = "".join(chr(zero + d) for zero in (0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xDE6) for d in range(10))
ASCII_DIGITS = "0123456789" * 10
