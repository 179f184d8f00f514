"""Fixed values of the data formats and of the analysis."""

from __future__ import annotations

# ---- Fixed values: they decide which rows and terms a result holds. -------

# Words dropped from dispatch titles and from term features.
STOP_WORDS = [
    "00", "000", "01", "02", "03", "04", "05", "06", "07", "08", "09", "a", "alors", "au", "aucun", "aussi", "autre",
    "aux", "avant", "avec", "avoir", "bon", "c", "ca", "car", "ce", "cela", "ces", "ceux", "chaque", "ci", "comme",
    "comment", "d", "dans", "de", "des", "dedans", "dehors", "depuis", "devrait", "doit", "donc", "du", "elle",
    "elles", "en", "encore", "est", "et", "etaient", "etions", "ete", "etre", "eu", "fait", "faites", "fois", "font",
    "hors", "ici", "il", "ils", "je", "juste", "l", "la", "le", "les", "leur", "ma", "maintenant", "mais", "mes",
    "moins", "mon", "mot", "meme", "n", "ne", "ni", "notre", "nous", "ont", "ou", "par", "parce", "pas", "peut",
    "peu", "plupart", "pour", "pourquoi", "quand", "que", "quel", "quelle", "quelles", "quels", "qui", "s", "sa",
    "sans", "ses", "seulement", "si", "sien", "son", "sont", "sous", "soyez", "sujet", "sur", "ta", "tandis",
    "tellement", "tels", "tes", "ton", "tous", "tout", "trop", "tres", "tu", "un", "une", "voient", "vont", "votre",
    "vous", "vu", "rt", "francais", "francaise", "france", "paris", "parisien", "afp", "parisienne", "Twitter",
    "politique",
]

# Entity words that make no useful query.
EXCLUDED_ENTITIES = ["", "francais", "francaise", "j", "son", "france", "paris", "parisien", "afp", "parisienne"]

# Title phrases of dispatches that are no news (weather, agenda, press review).
EXCLUDED_TITLES = [
    "A la Une à", "À la une à", "A la une à", "Ils ont dit", "Ils l'ont dit", "AGENDA HEBDO REGIONS",
    "A NOTER POUR AUJOURD HUI", "A NOTER POUR AUJOURD'HUI", "Le temps", "Le tour du monde des insolites",
    "Ce que disent les éditorialistes", "EN ATTENDANT DEMAIN", "APRES DEMAIN", "APRES-DEMAIN",
    "LUNDI", "MARDI", "MERCREDI", "JEUDI", "VENDREDI", "SAMEDI", "DIMANCHE",
]

SPORT_SUBJECT = "15000000"
STREAM_TAGS = ["_filter", "_sample"]
MISSING_ID = "-1"

# Report sizes and thresholds.
MIN_EVENT_POSTS = 25
MIN_FIELD_POSTS = 10
MAX_EVENTS = 5000
MAX_FIELD_VALUES = 5000
MAX_ROOT_POSTS = 20000
MAX_POSTS_PER_QUERY = 100000
LINES_PER_FILE = 1000
MIN_TERM_TEXTS = 2
MIN_TERM_WEIGHT = 0.3
PHRASE_MIN_COUNT = 5
PHRASE_THRESHOLD = 10.0

# Patterns (Java syntax).
URL_OR_MENTION = r"(?U)https?\S+|@\S+"
TERM_TOKEN = r"(?U)\b\w\w+\b"
WORD_TOKEN = r"(?U)\w+"
WORD_OR_PUNCT = r"(?U)\w+|[^\w\s]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Event ids are dispatch file names: "<agency>-YYYYMMDDTHHMMSSZ-<codes>".
EVENT_ID = r"[A-Za-z.]+-\d{8}T\d{6}Z(?:-[A-Z0-9]+)+"
EVENT_TIME = r"-(\d{8}T\d{6})Z-"
# --------------------------------------------------------------------------
