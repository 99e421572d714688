"""Word lists of the normalisers."""

from __future__ import annotations

# US states, full name -> code.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "district of columbia": "dc", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il",
    "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt",
    "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny",
    "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa",
    "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut",
    "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
}

# Indian states, full name -> codes and former names.
INDIA_STATES = {
    "andhra pradesh": ["ap"], "arunachal pradesh": ["ar"], "assam": ["as"], "bihar": ["br"], "chhattisgarh": ["cg", "ct"], "goa": ["ga"],
    "gujarat": ["gj"], "haryana": ["hr"], "himachal pradesh": ["hp"], "jharkhand": ["jh"], "karnataka": ["ka"], "kerala": ["kl"],
    "madhya pradesh": ["mp"], "maharashtra": ["mh"], "manipur": ["mn"], "meghalaya": ["ml"], "mizoram": ["mz"], "nagaland": ["nl"],
    "odisha": ["od", "or", "orissa"], "punjab": ["pb"], "rajasthan": ["rj"], "sikkim": ["sk"], "tamil nadu": ["tn"],
    "telangana": ["tg", "ts"], "tripura": ["tr"], "uttar pradesh": ["up"], "uttarakhand": ["uk", "ut", "uttaranchal"],
    "west bengal": ["wb"], "delhi": ["dl"], "jammu and kashmir": ["jk"], "chandigarh": ["ch"], "puducherry": ["py", "pondicherry"],
}

# Address abbreviations.
ADDRESS_ABBREVIATIONS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "bd": "boulevard",
    "bld": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place", "sq": "square", "hwy": "highway",
    "pkwy": "parkway", "cir": "circle", "trl": "trail", "ter": "terrace", "ste": "suite", "apt": "apartment", "fl": "floor",
    "flr": "floor", "bldg": "building", "n": "north", "s": "south", "e": "east", "w": "west", "ne": "northeast",
    "nw": "northwest", "se": "southeast", "sw": "southwest", "mt": "mount", "ft": "fort", "hts": "heights", "nr": "near",
    "opp": "opposite", "sec": "sector", "pkt": "pocket", "ngr": "nagar", "mkt": "market", "clny": "colony", "r": "rue",
    "ch": "chemin", "imp": "impasse", "all": "allee", "rte": "route", "fg": "faubourg", "crs": "cours", "qu": "quai",
    "res": "residence",
}

# Address words without meaning.
ADDRESS_DROPPED = ["no", "number", "null", "none", "nan", "na", "po", "box"]

# Name abbreviations.
NAME_ABBREVIATIONS = {
    "pvt": "private", "prvt": "private", "ltd": "limited", "ltda": "limited", "corp": "corporation", "inc": "incorporated",
    "incorp": "incorporated", "co": "company", "cie": "company", "intl": "international", "mfg": "manufacturing",
    "svcs": "services", "svc": "services", "bros": "brothers", "assoc": "associates", "assn": "association",
    "dept": "department", "ctr": "center", "centre": "center", "mgmt": "management", "tech": "technology", "et": "and", "n": "and",
}

# Legal forms, articles and honorifics, which leave the core of a name.
LEGAL = [
    "private", "limited", "llc", "llp", "lp", "incorporated", "corporation", "company", "plc", "pllc", "pc", "sarl", "sas",
    "sasu", "eurl", "sa", "sci", "snc", "scop", "the", "and", "of", "de", "du", "des", "la", "le", "les", "d", "l", "dr",
    "smt", "shri", "sri", "mr", "mrs", "ms", "m", "s", "opc",
]

# Digits read for letters, and those letters.
OCR_DIGITS, OCR_LETTERS = "0134568", "oleasgb"

# Patterns. The label of a web domain; markers of another name; anything outside Latin.
DOMAIN = r"\b(?:www\.)?([a-z0-9-]{3,})\.(?:co\.in|com|in|net|org|fr|biz|info|co|us)\b"
ALIAS = r"\b(?:a/k/a|aka|d/b/a|dba|t/a|f/k/a|fka|formerly)\b"
NON_LATIN = r"[^\x00-ɏḀ-ỿ]"


def state_names() -> dict[str, dict[str, str]]:
    """Country label -> address component -> canonical state. A country without an entry has no states."""
    india = {name: full.replace(" ", "") for full, short in INDIA_STATES.items() for name in (full, *short)}
    return {"US": {name: code for full, code in US_STATES.items() for name in (full, code)}, "India": india}
