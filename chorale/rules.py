"""Patterns, word lists and thresholds that define the results.

All of them are defaults of parameters; a caller may pass other ones.
"""

from __future__ import annotations

# --- Fixed values: accepted input -------------------------------------------------------------
REQUIRED_FIELDS = ["created_at", "review_id", "source", "text"]
OPTIONAL_FIELDS = ["rating", "language", "app_version"]
SOURCES = ["app_store", "google_play", "zendesk", "telegram", "nps", "email", "web"]
DEFAULT_SOURCE = "web"
MAX_UPLOAD_ROWS = 2000
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_QUARANTINE_RATIO = 0.05
STORED_TEXT_CHARS = 1000

# --- Fixed values: personal data (Java regex, Unicode classes on) ------------------------------
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?U)(?:(?:\+|00)\d{1,3}[-\s()]*)?(?:\d[-\s()]*){9,14}\d"
DEVICE = r"(?iU)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
URL = r"(?iU)https?://\S+"
NAME_HINT = (
    r"(?iU)\b(?:(my) name is|(i) am|(i'm)|(меня) зовут|(это)|(зовут))\s+[A-ZА-Я][a-zа-я]{2,20}\b"
)
# Order matters: a later mask sees the text left by the earlier ones.
MASKS = [
    (EMAIL, "[EMAIL]"),
    (PHONE, "[PHONE]"),
    (DEVICE, "[DEVICE_ID]"),
    (URL, "[URL]"),
    (NAME_HINT, "$1$2$3$4$5$6 [PERSON]"),
]
# What every match of a pattern holds.
NEEDED = {EMAIL: "@", DEVICE: "-", URL: "://"}
# What every maskable text contains; sentences without it are passed over.
MASKABLE = r"(?iu)[@\p{Nd}]|http|name is|i am|i'm|зовут|это"
RESIDUAL = [EMAIL, PHONE, DEVICE]
PERSON_LABELS = ["PERSON", "PER"]
LEAK_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LEAK_PHONE = r"(?U)\+?\d[\d\-\s()]{7,}\d"

# --- Fixed values: review flags ---------------------------------------------------------------
INJECTION_PHRASES = [
    "ignore previous instructions",
    "developer message",
    "system prompt",
    "return all stored data",
    "игнорируй предыдущие инструкции",
]
FLAG_ORDER = ["injection_suspected", "spam", "low_information", "pii_found", "mixed_language"]
REVIEWABLE_FLAGS = ["spam", "low_information", "injection_suspected"]
MIN_WORDS = 3
MIN_CHARS = 12
MAX_LINKS = 2
REPEATED_CHAR = r"(.)\1{6,}"
SPAM_UNIQUE_RATIO = 0.35
SPAM_PERPLEXITY = 3.2

# --- Fixed values: sentiment word lists -------------------------------------------------------
POSITIVE_WORDS = [
    "good", "great", "love", "fast", "stable", "smooth", "helpful", "excellent", "amazing",
    "удобно", "отлично", "круто", "быстро", "нравится", "полезно", "стабильно",
]
NEGATIVE_WORDS = [
    "bad", "broken", "bug", "bugs", "crash", "crashes", "slow", "hate", "problem", "annoying",
    "terrible", "ошибка", "плохо", "медленно", "лагает", "сломано", "вылетает", "ужасно", "баг",
]

# --- Fixed values: concepts, (id, label, patterns); every fragment of one pattern must occur ---
CONCEPTS = [
    ("payment_crash", "Payment flow crashes", [
        ["crash", "payment"], ["crash", "checkout"], ["вылет", "оплат"], ["вылетает", "оплат"],
        ["paywall", "crash"], ["payment", "screen"], ["экране", "карты"],
    ]),
    ("login_otp", "Login code delays", [
        ["login", "code"], ["sign", "code"], ["otp"], ["verification", "code"],
        ["код", "вход"], ["код", "подтверж"], ["sms", "code"],
    ]),
    ("billing_refund", "Billing and refunds", [
        ["subscription"], ["refund"], ["billing"], ["charged"],
        ["подпис"], ["возврат"], ["дважды"],
    ]),
    ("dark_mode", "Dark mode requests", [
        ["dark", "mode"], ["dark", "theme"], ["темн", "режим"], ["темн", "тема"],
    ]),
    ("notifications", "Notification delivery", [
        ["notification"], ["notifications"], ["уведомлен"],
    ]),
    ("performance_praise", "Positive UX feedback", [
        ["onboarding"], ["home", "screen"], ["главн", "экран"], ["stable"],
        ["стабиль"], ["быстр"], ["smooth"],
    ]),
    ("support_resolution", "Support resolution feedback", [
        ["support"], ["resolved"], ["email"], ["поддерж"],
    ]),
]
CONCEPT_REPEATS = 3

# --- Fixed values: stop words -----------------------------------------------------------------
CLUSTER_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "i", "if", "in", "is",
    "it", "me", "my", "of", "on", "or", "the", "this", "to", "too", "was", "with", "after",
    "again", "still", "every", "very", "latest", "please", "person", "email", "phone", "url",
    "device", "device_id",
    "бы", "в", "во", "для", "до", "же", "за", "и", "из", "как", "когда", "мне", "на", "не", "но",
    "о", "по", "после", "при", "с", "со", "слишком", "нужен", "у", "это", "очень",
]
SEARCH_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "for", "from", "i", "in", "is", "it", "my", "of",
    "on", "or", "the", "to", "with", "person", "email", "phone", "url",
    "в", "для", "и", "на", "не", "по", "с", "это",
]

# --- Fixed values: theme scoring --------------------------------------------------------------
PRIORITY_WEIGHTS = (0.5, 0.3, 0.2)
TREND_SCALE = 3.0
MOOD_MARGIN = 0.08
MIXED_MARGIN = 0.12
SPIKING_TREND = 0.5
HIGH_CONFIDENCE_SIZE = 8
MEDIUM_CONFIDENCE_SIZE = 4
WEAK_SIGNAL_SIZE = 3
LOW_DATA_ROWS = 30
MIN_HISTORY_WEEKS = 4
SPIKE_SIGMAS = 2.0
HIGH_SPIKE_RATIO = 2.0
QUOTES_PER_THEME = 5
REPORT_THEMES = 5
SPIKE_REASON = "Latest week count %d exceeded baseline threshold %s."

# --- Fixed values: clustering -----------------------------------------------------------------
MIN_CLUSTER_SIZE = 5
MIN_SAMPLES = 2
QUALITY_GATE = 0.35
DEGRADED_QUALITY = 0.03
MAX_CLUSTERS = 20

# --- Fixed values: retrieval ------------------------------------------------------------------
FUSION_WEIGHTS = (0.55, 0.25, 0.20)
MAX_HITS = 10
INTENTS = {
    "compare": r"(?iU)\b(compare|vs|versus|сравн)\b",
    "trend": r"(?iU)\b(trend|spike|growing|growth|динамик|всплеск|рост)\b",
    "report": r"(?iU)\b(report|summary|executive|отч[её]т|резюме)\b",
    "priority": r"(?iU)\b(highest|top|priority|urgent|critical|приоритет|главн|срочн)\b",
}
TOOLS = [
    "top_clusters", "search_clusters", "get_quotes", "get_trend", "compare_clusters",
    "get_report_section",
]
FIXED_QUESTIONS = [
    ("What is the highest-priority issue and what evidence supports it?", "payment_flow_crashes"),
    ("Which payment-related topic is spiking this week?", "payment_flow_crashes"),
    ("What login-related issue appears in this batch?", "login_code_delays"),
]

# --- Fixed values: merges ---------------------------------------------------------------------
MERGE_MIN_JACCARD = 0.1
MERGE_MAX_SENTIMENT_GAP = 0.6
MERGE_REASON = "llm_merge_review"
SPLIT_REASON = "llm_split_review"

# --- Fixed values: run states and metric buckets ----------------------------------------------
RECOVERY_JOB_STATES = ["RUNNING", "RETRYING", "DEGRADED_RUNNING"]
ACTIVE_JOB_STATES = ["QUEUED", *RECOVERY_JOB_STATES]
READY_SESSION_STATES = ["COMPLETED", "DEGRADED_COMPLETED"]
FAILURE_STATES = {
    "INPUT_SCHEMA_INVALID": "FAILED_INPUT",
    "INPUT_LIMIT_EXCEEDED": "FAILED_INPUT",
    "FAILED_INPUT": "FAILED_INPUT",
    "PRIVACY_GATE_FAILED": "FAILED_PRIVACY",
    "FAILED_PRIVACY": "FAILED_PRIVACY",
    "FAILED_PERSISTENCE": "FAILED_PERSISTENCE",
}
DEFAULT_FAILURE_STATE = "FAILED_RUNTIME"
JOB_LATENCY_EDGES = [1.0, 3.0, 5.0, 10.0, 20.0, 30.0, 45.0, 60.0, 120.0]
QUESTION_LATENCY_EDGES = [0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 12.0]
PROVIDER_LATENCY_EDGES = [0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
