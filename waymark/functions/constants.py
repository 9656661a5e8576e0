"""Word lists, weights, patterns and thresholds that results depend on."""

# ---- fixed values: interests, in vector order -------------------------------------
INTERESTS = [
    "heritage", "spiritual", "nature", "adventure", "food", "shopping", "museums", "photography", "relaxation",
    "wildlife",
]

# ---- fixed values: tag -> interest weights ----------------------------------------
TAG_INTERESTS = {
    "heritage": {"heritage": 1.0, "photography": 0.4},
    "unesco": {"heritage": 1.0, "photography": 0.6},
    "asi-monument": {"heritage": 1.0},
    "architecture": {"heritage": 0.9, "photography": 0.6},
    "fort": {"heritage": 1.0, "photography": 0.5, "adventure": 0.3},
    "palace": {"heritage": 1.0, "photography": 0.5},
    "history": {"heritage": 1.0},
    "memorial": {"heritage": 0.7, "relaxation": 0.3},
    "landmark": {"heritage": 0.6, "photography": 0.8},
    "winter-seat": {"heritage": 0.5, "spiritual": 0.8},
    "spiritual": {"spiritual": 1.0},
    "temple": {"spiritual": 1.0, "heritage": 0.5},
    "mosque": {"spiritual": 1.0, "heritage": 0.6},
    "monastery": {"spiritual": 1.0, "heritage": 0.5, "photography": 0.4},
    "buddhist": {"spiritual": 0.9, "heritage": 0.6},
    "jain": {"spiritual": 0.9, "heritage": 0.6},
    "pilgrimage": {"spiritual": 1.0},
    "ritual": {"spiritual": 0.9, "photography": 0.5},
    "nature": {"nature": 1.0},
    "garden": {"nature": 0.9, "relaxation": 0.7},
    "lake": {"nature": 0.9, "relaxation": 0.6, "photography": 0.5},
    "river": {"nature": 0.9, "photography": 0.5},
    "waterfall": {"nature": 1.0, "photography": 0.8},
    "viewpoint": {"nature": 0.8, "photography": 1.0},
    "beach": {"nature": 0.8, "relaxation": 0.9},
    "forest": {"nature": 1.0, "wildlife": 0.5},
    "hot-spring": {"nature": 0.7, "relaxation": 0.8},
    "high-altitude": {"nature": 0.9, "adventure": 0.7},
    "mountain": {"nature": 0.9, "adventure": 0.6, "photography": 0.5},
    "cave": {"nature": 0.7, "adventure": 0.8},
    "outdoor": {"nature": 0.6},
    "sunrise": {"photography": 0.9, "nature": 0.6},
    "adventure": {"adventure": 1.0},
    "trek": {"adventure": 1.0, "nature": 0.8},
    "activity": {"adventure": 0.9},
    "water": {"adventure": 0.8, "nature": 0.5},
    "swimming": {"adventure": 0.6, "relaxation": 0.6},
    "camping": {"adventure": 0.8, "nature": 0.7},
    "expert": {"adventure": 1.0},
    "base-camp": {"adventure": 0.6},
    "food": {"food": 1.0},
    "market": {"shopping": 0.9, "food": 0.6, "photography": 0.4},
    "shopping": {"shopping": 1.0},
    "urban": {"food": 0.4, "shopping": 0.5},
    "museum": {"museums": 1.0, "heritage": 0.5},
    "art": {"museums": 0.9, "heritage": 0.3},
    "science": {"museums": 0.9},
    "cultural": {"museums": 0.5, "heritage": 0.6},
    "research": {"museums": 0.7},
    "aviation": {"museums": 0.8},
    "entertainment": {"relaxation": 0.6, "museums": 0.2},
    "village": {"nature": 0.4, "photography": 0.4, "relaxation": 0.4},
    "unique": {"photography": 0.5, "heritage": 0.3},
    "offbeat": {"nature": 0.4, "adventure": 0.4},
    "hidden-gem": {"heritage": 0.5, "photography": 0.4},
    "wildlife": {"wildlife": 1.0, "nature": 0.7},
    "birding": {"wildlife": 1.0, "nature": 0.6},
    "safari": {"wildlife": 1.0, "adventure": 0.5},
    "photo-spot": {"photography": 1.0},
    "family": {"relaxation": 0.4},
    "modern": {"photography": 0.3},
    "free": {},
    "day-trip": {},
    "indoor": {},
    "border": {"photography": 0.3},
    "permit-required": {},
    "boating": {"adventure": 0.5, "relaxation": 0.5, "nature": 0.4},
}

# ---- fixed values: tokenizer stop list --------------------------------------------
STOP_WORDS = [
    "a", "an", "the", "of", "and", "or", "but", "if", "in", "on", "at", "to", "for", "from", "by", "with", "without",
    "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "it", "its", "as", "we",
    "you", "i", "they", "he", "she", "them", "us", "our", "your", "their", "there", "here", "do", "does", "did",
    "done", "have", "has", "had", "can", "could", "should", "would", "may", "might", "will", "shall", "about", "into",
    "over", "under", "than", "then", "so", "such", "very", "more", "most", "some", "any", "each", "which", "who",
    "whom", "what", "when", "where", "why", "how",
]

# ---- fixed values: question topics, first match wins ------------------------------
TOPIC_PATTERNS = [
    (
        "etiquette",
        r"\b(wear|wearing|dress\w*|etiquette|custom\w*|shoe\w*|footwear|cover\w*|modest\w*"
        r"|photograph\w*|photo\w*|camera\w*|allowed|permitted|permit\w*|rule\w*|restrict\w*"
        r"|enter|entry\s+rules|non.?hindu\w*|prohibit\w*)\b",
    ),
    (
        "accessibility",
        r"\b(wheelchair\w*|accessib\w*|disabled|elderly|senior\w*|parents|step\w*|stair\w*"
        r"|walk\w*|mobility|pram|stroller|child\w*|kids|hard|difficult\w*|strenuous|climb\w*"
        r"|trek\w*|fit\w*|suitable)\b",
    ),
    (
        "visiting",
        r"\b(how\s+long|how\s+much\s+time|duration|hours?|open\w*|clos\w*|timing\w*|fee\w*"
        r"|cost\w*|ticket\w*|price\w*|best\s+time|when\s+(is|to|should)|what\s+time"
        r"|all\s+year|season\w*|available|before\s+visiting|need\s+to\s+know)\b",
    ),
    (
        "history",
        r"\b(histor\w*|built|build|made|construct\w*|who\s+built|when\s+was|origin\w*"
        r"|ancient|centur\w*|founded|found\w*|dynast\w*|ruler\w*|king\w*|emperor\w*"
        r"|abandon\w*|survive\w*|happened|what\s+are\s+the|what\s+is\s+the\s+\w+\s+pillar)\b",
    ),
    (
        "significance",
        r"\b(why|important\w*|significan\w*|famous|special|matter\w*|sacred|holy"
        r"|architect\w*|known\s+for|renowned|notable)\b",
    ),
    (
        "facts",
        r"\b(fact\w*|trivia|lesser.known|interesting|did\s+you\s+know|unusual|unique)\b",
    ),
]
TOPICS = [
    "history", "significance", "facts", "visiting", "accessibility", "etiquette",
]

# ---- fixed values: words that carry no evidence ------------------------------------
LIVE_WORDS = [
    "now", "today", "tonight", "currently", "current", "latest", "live", "present", "moment", "exactly", "exact",
    "realtime", "right", "this", "instant", "updated",
]
FRAMING_WORDS = [
    "happened", "happen", "happens", "matter", "tell", "know", "knew", "wondering", "curious", "please", "something",
    "really", "basically", "regarding", "concerning", "whats", "supposed",
]
CLOCK_TIME_PATTERN = r"^\d{1,2}(:\d{2})?(am|pm)?$|^\d{1,2}(am|pm)$"

# ---- fixed values: one-way synonyms ------------------------------------------------
SYNONYMS = {
    "price": ["fee", "entry", "rs", "ticket", "cost"],
    "prices": ["fee", "fees", "entry", "rs", "ticket"],
    "cost": ["fee", "entry", "rs", "ticket"],
    "costs": ["fee", "fees", "entry", "rs"],
    "charge": ["fee", "entry", "rs"],
    "charges": ["fee", "fees", "entry", "rs"],
    "fare": ["fee", "entry", "rs"],
    "rupees": ["rs", "inr", "fee", "entry"],
    "rupee": ["rs", "inr", "fee", "entry"],
    "inr": ["rs", "fee", "entry"],
    "money": ["fee", "entry", "rs"],
    "expensive": ["fee", "entry", "rs"],
    "fee": ["entry", "rs", "ticket"],
    "fees": ["entry", "rs", "ticket"],
    "ticket": ["entry", "fee", "rs"],
    "tickets": ["entry", "fee", "rs"],
    "admission": ["entry", "fee", "ticket", "rs"],
    "timing": ["hours", "opening", "opens", "closed"],
    "timings": ["hours", "opening", "opens", "closed"],
    "hours": ["opening", "opens", "closed"],
    "open": ["opening", "hours", "opens"],
    "opens": ["opening", "hours"],
    "closing": ["closed", "hours", "opening"],
    "closes": ["closed", "hours", "opening"],
    "shut": ["closed", "hours"],
    "duration": ["typical", "visit", "takes", "hours"],
    "long": ["typical", "visit", "takes", "duration"],
    "kids": ["child", "children"],
    "kid": ["child", "children"],
    "elderly": ["senior", "seniors"],
    "disabled": ["wheelchair", "accessible", "accessibility"],
    "wheelchair": ["accessible", "accessibility", "step", "ramp"],
    "accessible": ["wheelchair", "accessibility", "step", "ramp"],
    "attire": ["dress", "code", "clothing"],
    "clothing": ["dress", "code", "attire"],
    "wear": ["dress", "code", "shoe", "shoes"],
    "photos": ["photography", "camera", "photograph"],
    "photo": ["photography", "camera", "photograph"],
    "pictures": ["photography", "camera", "photograph"],
    "camera": ["photography", "photograph"],
    "busy": ["crowd", "crowds", "crowded"],
    "crowded": ["crowd", "crowds"],
    "rush": ["crowd", "crowds", "crowded"],
}

# ---- fixed values: instruction-like spans ------------------------------------------
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions",
    r"disregard\s+(the\s+)?(system|previous)\s+(prompt|instructions)",
    r"you\s+are\s+now\s+(a|an)\s+",
    r"reveal\s+(your\s+)?(system\s+prompt|instructions)",
    r"</?(system|assistant|human)>",
    r"\bBEGIN\s+SYSTEM\b",
    r"print\s+your\s+(prompt|instructions)",
]
INJECTION_REPLACEMENT = "[redacted-instruction]"

# ---- fixed values: level maps (catalogue features / live scoring / reranking) ------
CROWD_PENALTY_FEATURE = {"low": 0.0, "medium": 0.25, "high": 0.6, "very_high": 1.0}
CROWD_PENALTY_SCORING = {"low": 0.0, "medium": 0.3, "high": 0.65, "very_high": 1.0}
ACCESS_FEATURE = {"yes": 1.0, "partial": 0.55, "unknown": 0.3, "no": 0.0}
ACCESS_SCORING = {"yes": 1.0, "partial": 0.55, "unknown": 0.35, "no": 0.0}
CONFIDENCE = {"high": 1.0, "medium": 0.65, "low": 0.35}
SOURCE_FEATURE = {
    "official": 1.0, "government": 0.95, "encyclopedic": 0.6, "openstreetmap": 0.55, "editorial": 0.4,
}
SOURCE_AUTHORITY = {
    "official": 1.0, "government": 0.95, "encyclopedic": 0.7, "openstreetmap": 0.6, "editorial": 0.5,
}
INDOOR_SCORE = {"indoor": 1.0, "mixed": 0.5, "outdoor": 0.0}
EXPOSURE = {"indoor": 0.0, "mixed": 0.5, "outdoor": 1.0}

# ---- fixed values: travel model ----------------------------------------------------
EARTH_RADIUS_KM = 6371.0088
DETOUR = {"walk": 1.25, "car": 1.35, "taxi": 1.35, "public": 1.45, "mixed": 1.35}
SPEED_KMPH = {"walk": 4.2, "car": 24.0, "taxi": 24.0, "public": 16.0, "mixed": 21.0}
LEG_OVERHEAD_MIN = {"walk": 2.0, "car": 8.0, "taxi": 10.0, "public": 14.0, "mixed": 9.0}
PACE_MAX_ACTIVITIES = {"relaxed": 3, "balanced": 4, "packed": 6}
PACE_MAX_TRAVEL_MIN = {"relaxed": 150, "balanced": 210, "packed": 300}

# ---- fixed values: group ranking ---------------------------------------------------
ALPHA = 0.65
DEFICIT_BOOST = 0.25
SHORTLIST_BOOST = 0.35
ITEM_WEIGHT = 0.35
SCORE_WEIGHTS = {
    "interest_match": 0.30, "group_fairness": 0.15, "attraction_quality": 0.12,
    "weather_suitability": 0.12, "seasonal_suitability": 0.10, "accessibility_suitability": 0.09,
    "budget_suitability": 0.08, "evidence_quality": 0.04,
}
SCORE_PENALTIES = {"distance_penalty": 0.10, "crowd_penalty": 0.06}

# ---- fixed values: cost model ------------------------------------------------------
BASELINE_RATES = {
    "budget": {"stay": 1000.0, "food": 400.0, "local_transport": 300.0},
    "midrange": {"stay": 2800.0, "food": 1000.0, "local_transport": 700.0},
    "premium": {"stay": 7500.0, "food": 2400.0, "local_transport": 1600.0},
}
PER_KM_RATES = {
    "walk": (0.0, 0.0), "public": (2.0, 4.0), "car": (12.0, 18.0), "taxi": (16.0, 26.0),
    "mixed": (9.0, 15.0),
}
SPREAD_LOW, SPREAD_HIGH = 0.80, 1.30

# ---- fixed values: meals, day pools, radii -----------------------------------------
MEAL_MINUTES, MEAL_FROM, MEAL_TO, MEAL_TRAVEL = 50, 720, 870, 5
DAY_POOL = 9
TOP_UP_RADIUS_KM = 40.0
RELOCATION_KM = 60.0
BALANCE_MOVE_KM = 25.0

# ---- fixed values: retrieval -------------------------------------------------------
RRF_K, DENSE_POOL, LEXICAL_POOL, TOP_K = 60, 30, 30, 5
BM25_K1, BM25_B = 1.5, 0.75
MIN_EVIDENCE, CITATION_OVERLAP = 0.26, 0.30
EMBED_DIM = 384

# ---- fixed values: catalogue contracts ---------------------------------------------
LAT_RANGE, LON_RANGE = (6.5, 37.5), (68.0, 97.5)
STALE_DAYS = 400
ALLOWED_DOMAINS = [
    "gov.in", "nic.in", "ac.in", "unesco.org", "karnatakatourism.org", "salarjungmuseum.in", "hal-india.co.in",
    "taralaya.org", "shrikashivishwanath.org", "shreejagannatha.in", "bahaihouseofworship.in", "openstreetmap.org",
    "wikipedia.org", "wikidata.org",
]
PRIVATE_KEYS = [
    "lat", "lon", "latitude", "longitude", "coords", "coordinates",
]
DAY_NAMES = {"all": -1, "mon": 0, "tue": 1, "wed": 2, "thu": 3, "fri": 4, "sat": 5, "sun": 6}
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November",
    "December",
]
WMO_CONDITIONS = {
    0: "clear",
    1: "mostly_clear",
    2: "partly_cloudy",
    3: "overcast",
    45: "fog",
    48: "fog",
    51: "drizzle",
    53: "drizzle",
    55: "drizzle",
    61: "rain",
    63: "rain",
    65: "heavy_rain",
    66: "freezing_rain",
    67: "freezing_rain",
    71: "snow",
    73: "snow",
    75: "heavy_snow",
    77: "snow",
    80: "showers",
    81: "showers",
    82: "heavy_showers",
    85: "snow_showers",
    86: "snow_showers",
    95: "thunderstorm",
    96: "thunderstorm",
    99: "thunderstorm",
}
TOPIC_COVERS = {
    "history": ["history", "background"],
    "significance": ["significance", "history"],
    "facts": ["facts", "history"],
    "visiting": ["hours", "fees", "practical"],
    "accessibility": ["accessibility", "practical"],
    "etiquette": ["rules", "practical", "customs"],
}
