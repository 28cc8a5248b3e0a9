"""Word lists, patterns and thresholds that decide results.

Everything here is data.  The operators take these values as default
parameters, so another market or language needs another table, not other code.
"""

# --- fixed values: digits and price text -------------------------------------
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PRICE_SEPARATORS = [",", "،", ".", " "]
CURRENCY_WORDS = ["تومان", "ریال", "ﺗﻮﻣﺎﻥ", "ﺭﯾﺎﻝ", "تومن", "ریل"]
TOMAN_WORDS = ["تومان", "تومن", "ﺗﻮﻣﺎﻥ"]
RIAL_WORDS = ["ریال", "ریل", "ﺭﯾﺎﻝ"]
GROUPED_NUMBER = r"([0-9]{1,3}(?:[,،][0-9]{3})*(?:\.[0-9]{2})?)"
PLAIN_NUMBER = r"([0-9]+)"
CURRENCY_SUFFIX = {"toman": " تومان", "rial": " ریال"}
LOOKS_LIKE_PRICE = "تومان|ریال|[،.0-9]"

# --- fixed values: seller and title clean-up ---------------------------------
SELLER_PREFIXES = ["فروشگاه", "شرکت", "گروه", "مجموعه"]
SELLER_SUFFIXES = ["store", "shop", "group", "co"]
TITLE_NOISE_WORDS = ["اصل", "اصلی", "یدکی", "قطعه", "پارت", "part", "oem", "original"]
UNKNOWN = "UNKNOWN"
UNKNOWN_SELLER = "UNKNOWN_SELLER"
SELLER_ALIASES = {
    "پارت سنتر": ["فروشگاه پارت سنتر", "پارت سنتر", "partcenter"],
    "یدک شاپ": ["یدک شاپ", "yadakshop", "یدک‌شاپ"],
    "اتو پارت": ["اتو پارت", "autopart", "auto part"],
    "کری پارت": ["کری پارت", "carrypart", "carry part"],
    "ایران پارت": ["ایران پارت", "iranpart", "iran part"],
}

# --- fixed values: first-match term lexicons (requested parts) ---------------
PART_TYPE_TERMS = {
    "bumper": ["سپر", "bumper", "بامپر"],
    "headlamp": ["چراغ", "چراغ جلو", "headlight", "headlamp", "lamp"],
    "fender": ["گلگیر", "fender", "wing"],
    "hood": ["کاپوت", "hood", "bonnet"],
    "grille": ["جلوپنجره", "grille", "گریل", "جلو پنجره"],
    "mirror": ["آینه", "mirror", "آیینه"],
    "door": ["درب", "door", "در"],
    "taillight": ["چراغ عقب", "taillight", "tail light", "rear light"],
    "spoiler": ["اسپویلر", "spoiler", "بال عقب"],
    "running_board": ["رکاب", "running board", "side step"],
}
TRIM_TERMS = {
    "classic": ["کلاسیک", "classic"],
    "pro": ["پرو", "pro"],
    "pro_max": ["پرو مکس", "pro max", "promax", "پروماکس"],
    "eplus": ["e+", "ای پلاس", "eplus", "e plus"],
}
SIDE_TERMS = {
    "left": ["چپ", "left", "lh", "l"],
    "right": ["راست", "right", "rh", "r"],
    "front": ["جلو", "front", "f"],
    "rear": ["عقب", "rear", "back", "r"],
    "center": ["وسط", "center", "middle", "c"],
}
VARIANT_TERMS = {
    "led": ["led", "ال ای دی", "ال‌ای‌دی"],
    "halogen": ["halogen", "هالوژن"],
    "matrix": ["matrix", "مکس"],
    "xenon": ["xenon", "زنون", "کسنون"],
    "standard": ["استاندارد", "standard", "معمولی"],
    "oem": ["oem", "اصل", "اصلی", "اورجینال", "original"],
    "aftermarket": ["aftermarket", "am", "یدکی", "جایگزین"],
}
CAR_MODEL_TERMS = {
    "tiggo8": ["تیگو 8", "tiggo 8", "tiggo8", "tigo 8"],
    "tiggo7": ["تیگو 7", "tiggo 7", "tiggo7", "tigo 7"],
    "tiggo5": ["تیگو 5", "tiggo 5", "tiggo5", "tigo 5"],
    "arrizo6": ["آریزو 6", "arrizo 6", "arrizo6"],
    "arrizo5": ["آریزو 5", "arrizo 5", "arrizo5"],
}

# --- fixed values: last-match patterns (offer titles) ------------------------
NEGATIVE_PATTERNS = {
    "rear_lights": [
        "چراغ عقب", "چراغ پشت", "tail light", "taillight", "rear light",
        "چراغ ترمز", "brake light", "stop light",
    ],
    "fog_lights": [
        "مه‌شکن", "مه شکن", "fog light", "foglamp",
        "چراغ مه", "چراغ مه‌شکن", "چراغ مه شکن",
    ],
    "drl_lights": [
        "چراغ روز", "چراغ روشنایی روز", "daylight", "drl", "day running",
        "چراغ روشنایی", "led strip",
    ],
    "indicators": [
        "راهنما", "چراغ راهنما", "indicator", "turn signal", "blinker",
        "چراغ چشمک زن", "چراغ هشدار",
    ],
    "side_mirrors": [
        "آینه", "آیینه", "mirror", "side mirror", "wing mirror",
        "آینه جانبی", "آینه کناری",
    ],
    "interior_parts": [
        "داخل", "interior", "کابین", "cabin", "صندلی", "seat",
        "داشبورد", "dashboard", "کنسول", "console",
    ],
}
POSITIVE_PATTERNS = {
    "front_bumper": ["سپر جلو", "بامپر جلو", "front bumper", "bumper front"],
    "headlamp": ["چراغ جلو", "headlight", "headlamp", "چراغ اصلی", "main light"],
    "front_fender": [
        "گلگیر جلو", "fender front", "front fender", "wing front", "فندر جلو",
    ],
    "hood": ["کاپوت", "hood", "bonnet", "سقف موتور"],
    "grille": ["جلوپنجره", "grille", "گریل", "جلو پنجره", "radiator grille", "شبکه جلو"],
}
CAR_MODEL_PATTERNS = CAR_MODEL_TERMS
TRIM_PATTERNS = {
    "classic": ["کلاسیک", "classic"],
    "pro": ["پرو", "pro"],
    "pro_max": ["پرو مکس", "pro max", "promax", "پروماکس"],
    "eplus": [r"e\+", "ای پلاس", "eplus", "e plus"],
}
SIDE_PATTERNS = {
    "left": ["چپ", "left", "lh", "l"],
    "right": ["راست", "right", "rh", "r"],
    "front": ["جلو", "front", "f"],
}
TECH_PATTERNS = {
    "led": ["led", "ال ای دی", "ال‌ای‌دی"],
    "halogen": ["halogen", "هالوژن"],
    "matrix": ["matrix", "مکس"],
    "xenon": ["xenon", "زنون", "کسنون"],
}

# --- fixed values: weights and limits ----------------------------------------
RELEVANCE_WEIGHTS = {"part_type": 0.3, "car_model": 0.2, "side": 0.1, "trim": 0.1, "tech": 0.1}
WORD_OVERLAP_WEIGHT = 0.2
MIN_RELEVANCE = 0.3
MAX_CARDS_PER_SEARCH = 200  # limits of a run that fetches; jobs over archives take all
MAX_DRILL_DOWNS = 20
SAMPLE_URLS = {False: 3, True: 5}  # of a report row: single stage, two stage
MIN_LENGTH_RATIO = 0.7
MIN_WORD_OVERLAP = 0.6
MAX_PRICE_GAP = 0.05
COMPLETENESS_WEIGHTS = {
    "title_raw": 2, "price_raw": 3, "seller_name": 2,
    "product_url": 1, "seller_url": 1, "availability": 1, "currency_unit": 1,
}
SIDED_PART_TYPES = ["HEADLAMP", "FENDER", "MIRROR"]
ISSUE_TEXT = {
    "part_type": "Could not identify part type",
    "car_model": "Could not identify car model",
    "side": "Could not identify side for part that typically has left/right variants",
    "trim": "Could not identify trim level",
}
NO_URLS_TEXT = "No URLs available"
KEYWORD_SUFFIX = " automotive part"

# --- fixed values: page layout -----------------------------------------------
EMBEDDED_MARKER = "__NEXT_DATA__"
EMBEDDED_JSON = r"(?s)<script[^>]*>.*?__NEXT_DATA__.*?(\{.*?\})</script>"
EMBEDDED_PRODUCTS_PATH = "$.props.pageProps.products"
SELLER_IN_SHOP_TEXT = r"در\s+([^،]+)"
CARD_LINK_PART = "/p/"
MIN_CARD_TITLE = 5
NO_RESULTS_SELECTORS = [".no-results", ".empty-state", ".no-products"]
CARD_PRICE_SELECTORS = ["[class*=price]", ".price", ".product-price", "span"]
CARD_SELLER_SELECTORS = [
    ".ProductCard_desktop_seller__3LVVm", ".seller-name", ".shop-name", ".store-name", "span",
]
AVAILABILITY_SELECTORS = [".availability", ".stock-status", ".in-stock"]
OFFER_SELECTORS = [
    ".offer-card", ".seller-offer", ".price-comparison-item",
    "[class*=offer]", "[class*=seller]", "[class*=price]",
]
OFFER_SELLER_SELECTORS = [
    ".seller-name", ".shop-name", ".store-name", "[class*=seller]", "[class*=shop]",
]
OFFER_PRICE_SELECTORS = [".price", ".product-price", "[class*=price]", "[class*=cost]"]
OFFER_LINK_SELECTORS = ["a[href*=/shop/]", "a[href*=/seller/]", "a"]
SELLER_LINK_WORDS = ["shop", "seller"]
