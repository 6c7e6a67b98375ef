"""Word lists, patterns and constants that results depend on. Java dialect; (?iU) folds case and knows Unicode."""

# ---- fixed values: documents ----
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FOUNDED = r"(?:E\s*ST\s*\.?\s*1957)"
LETTERHEAD_DATE = rf"(?iU)(?:committee|release)(?:\s+E\s*ST\s*\.?\s*1957)?\s+({MONTH})\s+(\d{{1,2}})\s*,?\s+(\d{{4}})"
TITLE_MONTH = rf"(?iU)\b({MONTH})\s*,?\s*(\d{{4}})"
FULL_TITLE_MONTH = r"(?iU)\b(january|february|march|april|may|june|july|august|september|october|november|december)\s*,?\s*(\d{4})"
ORDINAL = r"(?iU)\b(\d{1,3})\s?(?:st|nd|rd|th)\b"
ORDINAL_NEIGHBOURS = ("meeting", "mpc", "monetary policy committee")
RATE_MENTION = r"(?iU)policy rate|prime rate|\bMPR\b"
PERCENT = r"(?iU)(\d{1,2}(?:\.\d+)?)\s*(?:per\s*cent|percent|%)"
STATEMENT_TYPES = ("press_release", "emergency", "highlights")
SUPPORT_WORDS = ("summary of economic", "charts", "developments report", "inflation outlook", "global economic developments", "impact of covid", "infographic")
LENGTH_TOLERANCE = 0.02

# ---- fixed values: segmentation ----
LETTERHEAD_BLOCK = rf"(?isU)\A.{{0,300}}?(?:committee|release)\s*(?:{FOUNDED}\s*)?{MONTH}\s*(?:\d{{1,2}}\s*,?\s*)?\d{{4}}(?:\s*{FOUNDED})?"
GLYPHS = "•▪◦●■·"
NUMBERED = r"(?U)^\(?\d{1,3}[.)]\s+(?=\S)"
BULLET = rf"(?U)^(?:[{GLYPHS}]\s*|\(cid:\d+\)\s*|[-–—]\s+(?=[A-Z]))"
INLINE_BULLET = rf"(?U)\s+[{GLYPHS}]\s+|\(cid:\d+\)"
LETTERHEAD_WORDS = r"(?iU)^(?:(?:bank of ghana|monetary policy committee|press release|press briefing|public)\s*)+$"
DEBRIS = r"(?iU)press statement|for immediate release|release date|\best\b|full text|kofgh"
ISSUER = "bank of ghana"
PAGE_NUMBER = r"(?iU)^(?:page\s+)?\d{1,3}(?:\s*(?:of|/)\s*\d{1,3})?$"
MID_NUMBER = r"(?U)(?<=[.!?])\s+\d{1,3}\.\s+(?=[A-Z])"
LIST_MARKER = r"(?U)^[A-Z]\.\s+"
INLINE_HEADING = r"(?U)^((?:[A-Z][A-Za-z’'/&-]*\s+){0,7}[A-Z][A-Za-z’'/&-]*)\s+(?=\d{1,3}\.\s+[A-Z])"
STOPWORDS = ("and", "of", "the", "in", "to", "for", "on", "a", "an", "with", "by", "at", "from", "&")
STAND_IN = "․"
ABBREVIATION = r"(?U)(\b(?:U\.S|U\.K|E\.U|e\.g|i\.e|a\.m|p\.m|p\.a|vs|Dr|Mr|Mrs|Ms|Prof|Hon|Gov|No|Nos|Fig|approx|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|St|Ltd|Inc|Co|Corp|Dept|Govt))\."
INITIAL = r"(?U)(\b[A-Z])\.(?=\s+[A-Z])"
SENTENCE_END = r"(?U)(?:(?<=[.!?])|(?<=[.!?][\"”’)\]]))\s+(?=[\"“(\[]?[A-Z0-9])"
SHORT_ABBREVIATIONS = ("U.S.", "U.K.", "e.g.", "i.e.", "No.", "Mr.", "Mrs.", "Dr.", "St.", "vs.", "etc.")
SHORT_END = r"(?U)(?<=[.!?])\s+(?=[A-Z\[(\"“])"
SECTION_HINTS = (
    ("admin", r"information(?:al)? note"),
    ("global", r"global|world|international"),
    ("inflation", r"inflation|price"),
    ("growth", r"growth|real sector|economic activity|output"),
    ("fiscal", r"fiscal|budget|government|debt"),
    ("external", r"external|exchange rate|balance of payments|reserves|foreign|trade"),
    ("financial", r"financial|monetary|banking|credit|money market|interest rate"),
    ("decision", r"decision|conclusion|policy stance|outlook"),
)

# ---- fixed values: decision sentences ----
RATE_TERM = r"(?iU)\b(?:policy rate|prime rate|monetary policy rate|MPR|policy stance)\b"
ANNOUNCED_RATE = r"(?iU)\bdecid\w*\s+to\s+(?:\w+\s+){0,3}(?:the\s+|its\s+)?rate\b"
IMPERATIVE = r"(?iU)^(?:increase|raise|reduce|lower|cut|decrease|maintain|keep|retain|hold)\b"
ACTION = r"(?iU)\b(?:maintain|keep|kept|retain|hold|held|unchanged|raise|increase|reduce|lower|cut|decrease|hike|ease|tighten)\w*\b"
ANNOUNCE = r"(?iU)\b(?:decid\w*|decision|voted?|agreed|resolved?)\b"
ACTED = "(?:maintained|kept|retained|held|raised|increased|reduced|lowered|cut|decreased|hiked)"
DIRECT_ACTION = rf"(?iU)\b(?:committee|mpc)\s+(?:therefore\s+|accordingly\s+|also\s+|thus\s+)?{ACTED}\b|\b(?:therefore|accordingly|thus|hence)\s+{ACTED}\b"
OTHER_BANKS = r"(?U)\b(?:Fed|Federal Reserve|FOMC|ECB|European Central Bank|Bank of England|Bank of Japan|SARB|Reserve Bank|CBN|Central Bank of Nigeria)\b"

# ---- fixed values: rule engine ----
MOVES = {
    "UP": r"\b(?:rose|rise|rises|rising|risen|increase[sd]?|increasing|accelerat\w+|picked up|pick up|edged up|jump\w*|surg\w+|climb\w*|spik\w+|higher|grew|grow|grows|growing|grown|expand\w*|widen\w*|deteriorat\w+|worsen\w*|intensif\w+|escalat\w+|mount\w*|heighten\w*|improv\w+|accumulat\w+|strengthen\w*|up(?!\s+to\b))\b",
    "DOWN": r"\b(?:fell|fall|falls|falling|fallen|declin\w+|decreas\w+|drop\w*|ease|eas(?:ed|es|ing)|moderat\w+|slow\w*|subsid\w+|lower|lowered|reduc\w+|narrow\w+|contract\w+|weaken\w*|slump\w*|soften\w*|dampen\w*|dip\w*|retreat\w*|cool\w*|abat\w+|recede\w*|shrink\w*|shrank|deceler\w+|halv\w+|plung\w+|collaps\w+|down)\b",
    "HIGH": r"\b(?:elevated|above|exceed\w*|breach\w*|overshoot\w*|high|persist\w*|stubborn\w*|entrenched)\b",
    "LOW": r"\b(?:below|subdued|benign|anchored|contained|muted)\b",
}
NEGATORS = ("not", "no", "never", "without", "unlikely", "fail", "failed", "fails")
TOPIC_ORDER = ("policy", "global", "external", "fiscal", "financial", "inflation", "growth", "other")
HINT_TOPICS = ("global", "inflation", "growth", "fiscal", "external", "financial")

# ---- fixed values: sampling, index, validation ----
ERAS = (("2002-2009", 2002, 2009), ("2010-2016", 2010, 2016), ("2017-2021", 2017, 2021), ("2022-2026", 2022, 2026))
QUOTAS = {"2002-2009": 90, "2010-2016": 90, "2017-2021": 80, "2022-2026": 140}
RANDOM_SHARE, DEV_SHARE, MAX_PER_DOC = 0.4, 0.25, 8
TONES = ("hawkish", "neutral", "dovish")
LAST_TRAIN_YEAR, LAST_VALIDATION_YEAR, SPLIT_YEAR = 2018, 2021, 2018
LEVEL_SKIP = r"(?iU)core|food|expectation|forecast|project|expected|anticipat|outlook|real |month[- ]on[- ]month|m-o-m|m/m|quarter[- ]on[- ]quarter|q-o-q"
NOT_A_LEVEL = r"(?iU)target|band|objective|range|ceiling|limit|programme"
LEVEL = r"(?iU)\binflation\b.{0,160}?\b(?:rose|fell|declined|increased|decreased|eased|moderated|accelerated|picked up|stood|stands|remained|remains|was|is|at|to|of)\s+(?:marginally\s+|slightly\s+|further\s+|sharply\s+|steadily\s+|again\s+)?(?:at\s+|to\s+)?(\d{1,2}(?:\.\d+)?)\s*(?:per\s*cent|percent|%)"
