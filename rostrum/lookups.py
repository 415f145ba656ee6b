"""Word lists, lookup tables and patterns that results depend on.

Nothing here is logic. Every table lists the values as data, in natural order. The tag taxonomy is not
a constant: it is a table the caller passes in (see ``operators.joins.tag_category_lookup``).
"""

from __future__ import annotations

# ---- fixed values: source names, topics of feed files and of academic subjects -----------------
PREFERRED_SOURCE = "callingallpapers"

FEED_TOPIC_TO_CATEGORY = {
    "android": "mobile", "ios": "mobile", "css": "frontend", "javascript": "frontend",
    "typescript": "frontend", "ux": "design", "data": "data", "devops": "devops", "dotnet": "backend",
    "elixir": "backend", "golang": "backend", "graphql": "api", "java": "backend", "kotlin": "backend",
    "networking": "infrastructure", "php": "backend", "python": "backend", "ruby": "backend",
    "rust": "backend", "scala": "backend", "security": "security", "tech-comm": "career",
    "general": "general", "leadership": "leadership", "product": "product", "api": "api",
    "clojure": "backend",
}

SUBJECT_TO_CATEGORY = {
    "ML": "ai-ml", "CV": "ai-ml", "NLP": "ai-ml", "RO": "robotics", "SP": "ai-ml", "DM": "data",
    "AP": "ai-ml", "KR": "ai-ml", "HCI": "design", "IRSM": "data", "MISC": "general",
}

PRIMARY_CATEGORIES = [
    "frontend", "backend", "fullstack", "mobile", "devops", "cloud", "ai-ml", "data", "security",
    "design", "architecture", "languages", "testing", "agile", "leadership", "career", "open-source",
    "gaming", "iot", "blockchain",
]

# ---- fixed values: places -----------------------------------------------------------------------
ONLINE_WORDS = ["online", "virtual", "remote", "worldwide"]

US_STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas",
    "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
    "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana",
    "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma",
    "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont",
    "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
    "DC": "District of Columbia",
}

US_REGIONS = {
    "Midwest": ["Illinois", "Indiana", "Iowa", "Kansas", "Michigan", "Minnesota", "Missouri", "Nebraska",
                "North Dakota", "Ohio", "South Dakota", "Wisconsin"],
    "Northeast": ["Connecticut", "Maine", "Massachusetts", "New Hampshire", "New Jersey", "New York",
                  "Pennsylvania", "Rhode Island", "Vermont"],
    "Southeast": ["Alabama", "Arkansas", "Delaware", "Florida", "Georgia", "Kentucky", "Louisiana",
                  "Maryland", "Mississippi", "North Carolina", "South Carolina", "Tennessee", "Virginia",
                  "West Virginia", "District of Columbia"],
    "Southwest": ["Arizona", "New Mexico", "Oklahoma", "Texas"],
    "West": ["Alaska", "California", "Colorado", "Hawaii", "Idaho", "Montana", "Nevada", "Oregon", "Utah",
             "Washington", "Wyoming"],
}

COUNTRY_CONTINENT = {
    "USA": "North America", "United States": "North America", "US": "North America", "Canada": "North America",
    "Mexico": "North America", "UK": "Europe", "United Kingdom": "Europe", "England": "Europe",
    "Scotland": "Europe", "Germany": "Europe", "France": "Europe", "Spain": "Europe", "Italy": "Europe",
    "Netherlands": "Europe", "Belgium": "Europe", "Austria": "Europe", "Switzerland": "Europe",
    "Poland": "Europe", "Czech Republic": "Europe", "Czechia": "Europe", "Sweden": "Europe", "Norway": "Europe",
    "Denmark": "Europe", "Finland": "Europe", "Ireland": "Europe", "Portugal": "Europe", "Greece": "Europe",
    "Romania": "Europe", "Hungary": "Europe", "Bulgaria": "Europe", "Croatia": "Europe", "Slovenia": "Europe",
    "Slovakia": "Europe", "Serbia": "Europe", "Ukraine": "Europe", "Estonia": "Europe", "Latvia": "Europe",
    "Lithuania": "Europe", "Luxembourg": "Europe", "Malta": "Europe", "Cyprus": "Europe", "Iceland": "Europe",
    "Japan": "Asia", "China": "Asia", "India": "Asia", "South Korea": "Asia", "Korea": "Asia",
    "Singapore": "Asia", "Thailand": "Asia", "Vietnam": "Asia", "Malaysia": "Asia", "Indonesia": "Asia",
    "Philippines": "Asia", "Taiwan": "Asia", "Hong Kong": "Asia", "Israel": "Asia", "UAE": "Asia",
    "United Arab Emirates": "Asia", "Dubai": "Asia", "Australia": "Oceania", "New Zealand": "Oceania",
    "Brazil": "South America", "Argentina": "South America", "Chile": "South America",
    "Colombia": "South America", "Peru": "South America", "South Africa": "Africa", "Nigeria": "Africa",
    "Kenya": "Africa", "Egypt": "Africa",
}

EUROPE_REGIONS = {
    "Western Europe": ["France", "Belgium", "Netherlands", "Luxembourg", "Germany", "Austria", "Switzerland"],
    "Northern Europe": ["UK", "United Kingdom", "England", "Scotland", "Ireland", "Sweden", "Norway",
                        "Denmark", "Finland", "Iceland", "Estonia", "Latvia", "Lithuania"],
    "Southern Europe": ["Spain", "Portugal", "Italy", "Greece", "Malta", "Cyprus", "Croatia", "Slovenia"],
    "Eastern Europe": ["Poland", "Czech Republic", "Czechia", "Hungary", "Romania", "Bulgaria", "Slovakia",
                       "Serbia", "Ukraine"],
}

COUNTRY_ALIASES = {
    "US": "USA", "United States": "USA", "United States of America": "USA", "UK": "United Kingdom",
    "England": "United Kingdom", "Scotland": "United Kingdom", "Wales": "United Kingdom",
    "Czechia": "Czech Republic", "Korea": "South Korea", "Holland": "Netherlands",
}

# ---- fixed values: talk titles and channels -----------------------------------------------------
NAME_PATTERN = (
    r"[A-Z][a-zàáâãäåæçèéêëìíîïñòóôõöùúûüý]+"
    r"(?:\s+[A-Z][a-zàáâãäåæçèéêëìíîïñòóôõöùúûüý]+){1,3}"
)
TITLE_CONFERENCES = [
    "NDC", "JSConf", "PyCon", "GopherCon", "React", "KubeCon", "CNCF", "DevCon", "Conf42", "FOSDEM",
]
CONFERENCE_YEAR_PATTERN = (
    r"(?i)(?:pycon|jsconf|reactconf|vueconf|kubecon|dotnet|dotai|ndc|goto|strangeloop|infoq|velocity|"
    r"rubyconf|elixirconf|rustconf|gophercon|defcon|bsides|fosdem|jsworld|vueconf|react\s?world|"
    r"frontend\s?nation|tech\s?talk|tech\s?conference|shift|strapi|nuxt|vue|react|js|all\s?hands|devfest|"
    r"meetup|summit|symposium)\s*[:#\s\-]?\s*(\d{4})"
)
PROMO_WORDS = ["trailer", "teaser", "promo", "highlight", "aftermovie", "recap"]
TALK_BLOCKED_WORDS = [
    "official video", "music video", "lyric video", "audio only", "full album", "greatest hits", "best of",
    "remaster", "unplugged", "mtv", "vevo", "gun show", "guns n roses", "oasis", "apex legends",
    "beginner guide", "gaming", "chromebook", "amazon shipment", "vanlife", "tawheed", "allah",
    "career advice", "highest paying", "get rich", "how to beat", "slasher", "walkthrough", "gameplay",
    "playthrough", "cnc design", "ultimate guide", "before 2025", "before 2026", "tutorial for beginners",
    "course for beginners", "easy business", "make money", "side hustle", "passive income", "dropshipping",
]
CHANNEL_BLOCKED_WORDS = ["vevo", "music", "records", "entertainment", "gaming"]
TECH_WORDS = [
    "tech talk", "presentation", "keynote", "session", "meetup", "developer", "programming", "software",
    "api", "cloud", "kubernetes", "docker", "devops", "infosec", "cybersecurity", "python", "javascript",
    "java", "react", "node", "rust", "golang", "typescript", "microservices", "architecture",
    "machine learning", "deep learning", "data science", "database", "sql", "nosql", "backend", "frontend",
    "fullstack", "aws", "azure", "gcp", "linux", "open source", "github", "cncf", "hashicorp", "terraform",
    "ansible", "jenkins", "pycon", "kubecon", "jsconf", "rustconf", "gophercon", "devoxx", "qcon",
    "strangeloop", "fosdem", "defcon", "bsides",
]
CONFERENCE_CHANNEL_WORDS = [
    "conference", "conf", "summit", "symposium", "forum", "fosdem", "defcon", "bsides", "kcc", "jsconf",
    "pycon", "kubecon", "reactconf", "vueconf", "rustconf", "gophercon", "dotai", "dotscale", "ndc", "qcon",
    "devoxx", "goto", "strangeloop", "infoq", "velocity", "rubyconf", "elixirconf", "clojureconf",
    "haskellconf", "scalaconf", "deno",
]
NOT_CONFERENCE_CHANNEL_WORDS = [
    "vercel", "netlify", "cloudflare", "aws", "azure", "gcp", "google", "microsoft", "apple", "meta",
    "netflix", "spotify", "stripe", "square", "uber", "lyft", "doordash", "twitch", "discord", "slack",
    "zoom", "github", "gitlab", "bitbucket", "docker", "kubernetes", "hashicorp", "terraform", "prisma",
    "mongodb", "postgresql", "redis", "elastic",
]
COMPANY_CHANNEL_WORDS = [
    "vercel", "netlify", "cloudflare", "aws", "amazon", "azure", "google", "microsoft", "apple", "meta",
    "netflix", "spotify", "stripe", "square", "shopify", "uber", "lyft", "doordash", "twitch", "discord",
    "slack", "zoom", "figma", "notion", "github", "gitlab", "bitbucket", "snyk", "sonatype", "docker",
    "kubernetes", "hashicorp", "terraform", "ansible", "prisma", "mongodb", "postgresql", "redis",
    "elastic", "mongo", "mysql", "cassandra", "intel", "amd", "nvidia", "qualcomm",
]

# ---- fixed values: names that are not people ----------------------------------------------------
BLOCKED_SPEAKERS = [
    # kinds of event
    "all keynotes", "tech talk", "tech session", "virtual event", "dev room", "main stage", "workshop",
    "tutorial", "panel", "lightning talk", "demo", "keynote", "opening", "closing", "live stream",
    "full talk", "conference talk", "tech talks", "opening keynote", "closing keynote",
    "sponsored keynote", "opening session", "closing session", "opening ceremony", "closing ceremony",
    "demo lab", "on tutorial",
    # technical terms
    "functional programming", "java programs interview", "rust dev room", "system design",
    "data structure", "world example", "spring history", "maximum efficiency", "the download",
    "react admin", "azure malayalam", "unlocking digital", "code play repeat", "memory safety",
    "interview java", "java interview", "python interview", "coding interview", "technical interview",
    "programming tutorial", "coding tutorial", "web development", "software engineering",
    "software development", "full stack", "front end", "back end", "api design",
    # title-case phrases
    "applied psychology", "the carbon language", "platform engineering", "cloud native",
    "machine learning", "deep learning", "artificial intelligence", "open source", "best practices",
    "design patterns", "code review", "distributed systems", "microservices architecture",
    "event sourcing", "domain driven design", "test driven development", "behavior driven development",
    # beginnings of talk titles
    "beyond pandas", "beyond chat", "beyond java", "beyond labels", "beyond monitoring",
    "beyond orchestration", "beyond production", "building resilient", "scaling smarter",
    "scaling system", "modern routing", "based linting", "based threats", "unlocking digital ownership",
    "unlocking innovation", "optimising machine learning workflows", "optimizing istio autoscaling",
    "open source chaos engineering", "driven microservices adoption journey",
    # channels, playlists and companies
    "strange loop", "goto conference", "devoxx", "qcon", "infoq", "tech world", "developer advocate",
    "devrel", "community", "cloud training", "tech sherpas", "cloudnativefolks community",
    "testcontainers desktop", "playwright java", "swift programming logic", "windows developer",
    "umbraco keynote", "vispero responds", "many lives",
    # fragments of titles
    "part one", "part two", "part 1", "part 2", "episode 1", "episode 2", "day one", "day two", "day 1",
    "day 2", "session 1", "session 2", "complete guide", "crash course", "deep dive", "getting started",
    "introduction to", "beginner guide", "advanced guide", "ultimate guide",
]
NOT_A_PERSON_PATTERNS = [
    r"^build\s+stage$", r"^transform\s+stage$", r"^main\s+stage$", r"^lightning\s+talks?$",
    r"^conference\s+talk", r"^keynote\s+", r"^tech\s+talk", r"^workshop\s+", r"^talk\s+", r"^session\s+",
    r"^panel\s+", r"^intro(dduction)?\s+to\s+", r"^how\s+to\s+", r"^what\s+is\s+", r"^why\s+",
    r"^building\s+", r"^running\s+", r"^getting\s+started", r"^deep\s+dive", r"^beginner", r"^advanced",
    r"^crash\s+course", r"^complete\s+guide", r"^ultimate\s+guide", r"^practical\s+", r"^real-world\s+",
    r"^scale?\s+", r"^grade\s+", r"^exceptional\s+", r"^english\s+speaking", r"^compiling\s+your\s+",
    r"^data\s+mesh", r"^data\s+engineering", r"^machine\s+learning", r"^cloud\s+native", r"^serverless",
    r"^microservices", r"^devops", r"^ci/cd", r"^agile", r"^scrum", r"^kanban", r"^productivity",
    r"^time\s+management", r"^coding\s+", r"^programming\s+", r"^software\s+", r"^system\s+design",
    r"^api\s+", r"^frontend\s+", r"^backend\s+", r"^fullstack", r"^database\s+", r"^sql\s+", r"^nosql",
    r"^aws\s+", r"^azure\s+", r"^gcp\s+", r"^kubernetes", r"^docker", r"^terraform", r"^ansible",
    r"^jenkins", r"^github", r"^git", r"^linux", r"^unix", r"^python", r"^javascript", r"^typescript",
    r"^rust", r"^go\s+", r"^golang", r"^java", r"^c\+\+", r"^c#", r"^ruby", r"^php", r"^swift",
    r"^kotlin", r"^scala", r"^clojure", r"^haskell", r"^elm", r"^reasonml", r"^react", r"^vue",
    r"^angular", r"^svelte", r"^node", r"^nodejs", r"^deno",
]
QUESTION_START_PATTERN = r"^(how|what|why|when|where|which|who|whose)\s"
EVENT_WORDS = ["conference", "summit", "symposium", "forum", "meetup", "workshop", "training"]
GARBAGE_PATTERNS = [
    r"^(opening|closing)\s+(keynote|ceremony|session)", r"^demo\s+(lab|session|room)", r"keynote$",
    r"^(tech|cloud|azure|aws|gcp)\s+(talk|training|session|sherpas)",
    r"^(beyond|based|applied|advanced|modern)\s+\w+$", r"^(unlocking|building|scaling|optimizing)\s+",
    r"^(react|vue|angular|python|java|rust)\s+(admin|dev|programming)",
    r"\s+(interview|tutorial|guide|workshop|webinar)$", r"^(many|several|multiple)\s+\w+$", r"community$",
    r"^playwright\s+\w+$", r"^testcontainers\s+", r"^(windows|linux|mac)\s+developer$", r"^umbraco\s+",
    r"responds$", r"^swift\s+programming",
]
GARBAGE_SLUGS = [
    "beyond-pandas", "based-linting", "opening-keynote", "demo-lab", "many-lives", "cloud-training",
    "react-admin", "azure-malayalam", "tech-sherpas", "playwright-java", "cloudnativefolks-community",
    "windows-developer", "umbraco-keynote", "testcontainers-desktop", "vispero-responds",
    "swift-programming-logic", "driven-microservices-adoption-journey",
    "optimising-machine-learning-workflows", "open-source-chaos-engineering",
]

# ---- fixed values: speaker badges ---------------------------------------------------------------
CONTINENT_WORDS = {
    "NA": ["pycon us", "kubecon na", "render", "strangeloop", "defcon"],
    "EU": ["europe", " eu", "berlin", "london", "paris", "devoxx", "fosdem"],
    "Asia": ["asia", "tokyo", "singapore", "india", "china", "jsconf asia"],
    "Oceania": ["australia", "sydney", "melbourne"],
    "Africa": ["africa", "lagos", "cape town"],
    "LATAM": ["latam", "brazil", "argentina", "jsconf ar"],
}
LARGE_CONFERENCES = [
    "kubecon", "reinvent", "google i/o", "wwdc", "microsoft build", "aws summit", "defcon", "black hat",
    "pycon", "jsconf",
]

# ---- fixed values: community posts --------------------------------------------------------------
NOISE_PATTERNS = [
    r"\bthis week in\b", r"\bweekly(?: digest| roundup)?\b", r"\bmonthly\b", r"\bq&a\b", r"\bama\b",
    r"\bask me anything\b", r"\bshow hn\b", r"\bask hn\b", r"\btell me anything\b",
    r"\bi (?:built|made|wrote|created)\b", r"\bintroducing\b", r"\blooking for\b", r"\bhelp with\b",
    r"\bhow do i\b", r"\bissue #?\d+\b", r"\bfriday(?: is)? webday\b",
]
TITLE_WORD_PATTERN = r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)*\b"
NOISE_SUBREDDITS = [
    "kpop", "kpopthoughts", "unpopularkpopopinions", "kpoprants", "kpoppers", "kpop_uncensored",
    "kpophelp", "music", "popheads", "hiphopheads", "gaming", "games", "leagueoflegends", "valorant",
    "fortnitebr", "nba", "nfl", "soccer", "formula1", "sports",
]
REPO_STOPWORDS = ["2024", "2025", "2026", "the", "conference", "conf", "day", "days"]
REPO_OFFICIAL_WORDS = ["official", "website", "schedule", "app", "cfp", "call-for-papers"]
REPO_RELATED_WORDS = ["talk", "demo", "workshop", "presentation", "slides", "sample", "example"]
REPO_NOISE_WORDS = ["awesome", "list", "collection", "interview", "prep", "learning"]
REPO_YEARS = ["2024", "2025", "2026"]

# ---- fixed values: text repair and HTML ---------------------------------------------------------
MOJIBAKE = {
    "\xe2\x80\x99": "'", "\xe2\x80\x9c": '"', "\xe2\x80\x9d": '"', "\xe2\x80\x93": "-",
    "\xe2\x80\x94": "--", "\xc3\xa9": "e", "\xc3\xa0": "a", "\xc3\xb1": "n",
}
HTML_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}
TEXT_ENTITIES = {  # decoded where text nodes are read; the ampersand comes last
    "&nbsp;": "\u00a0", "&apos;": "'", "&#39;": "'", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&copy;": "©",
    "&reg;": "®", "&middot;": "·", "&bull;": "•", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&eacute;": "é", "&euro;": "€", "&amp;": "&",
}
SPA_MARKERS = [
    r"""<div\s+id=["'](?:root|app|__next|__nuxt)["']""", r"<script[^>]*(?:react|vue|angular|svelte)",
    r"window\.__INITIAL_STATE__", r"data-reactroot", r"ng-app", r"data-v-[a-f0-9]+",
]
SPA_MIN_TEXT = 500

# ---- fixed values: page mining ------------------------------------------------------------------
MONTH_NAMES = (
    "January|February|March|April|May|June|July|August|September|October|November|December|"
    "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
)
DATE_PATTERNS = [
    r"\b(\d{4}-\d{2}-\d{2})\b",
    r"\b((?:" + MONTH_NAMES + r")\s+\d{1,2},?\s+\d{4})\b",
    r"\b(\d{1,2}\s+(?:" + MONTH_NAMES + r")\s+\d{4})\b",
    r"\b(\d{1,2}/\d{1,2}/\d{4})\b",
]
CFP_PHRASES = [
    "call for papers", "call for proposals", "call for speakers", "call for presentations",
    "call for talks", "submit a talk", "submit a paper", "submit a proposal", "submission deadline",
    "paper submission", "abstract submission", "speaker submission",
]
DEADLINE_PHRASES = [
    "deadline", "due date", "closes", "submit by", "submissions close", "papers due", "abstracts due",
]
DATE_CLASS_WORDS = {
    "cfp_deadline": ["deadline", "submit", "cfp", "due", "close", "paper", "proposal"],
    "event_start": ["conference date", "event date", "starts", "begins", "opens"],
    "event_end": ["ends", "through", "until"],
}
TOPIC_WORDS = [
    "python", "javascript", "rust", "go", "java", "kotlin", "swift", "react", "vue", "angular", "node",
    "django", "flask", "rails", "kubernetes", "docker", "aws", "gcp", "azure", "cloud",
    "machine learning", "ai", "data science", "devops", "security", "frontend", "backend", "fullstack",
    "mobile", "web", "api", "microservices", "serverless", "blockchain",
]
TOPICS_INCLUDE_PATTERN = r"(?i)topics?\s*(?:include|:)\s*([^.]+)"
LABELLED_LOCATION_PATTERN = r"(?i)(?:location|venue|where|place)[:\s]+([^,\n]{3,50}(?:,\s*[^,\n]{2,30})?)"
CITY_PATTERN = (
    r"(?:in|at|held at)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?(?:,\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)?)"
)
JSONLD_EVENT_TYPES = ["Event", "EducationEvent", "BusinessEvent", "SocialEvent", "Festival"]
RELEVANT_LINE_WORDS = [
    "session", "format", "duration", "minute", "hour", "speaker", "benefit", "travel", "hotel",
    "accommodation", "ticket", "free", "attend", "participant", "people", "track", "topic", "category",
    "workshop", "talk", "presentation", "keynote", "panel", "lightning", "submission", "deadline", "close",
]

PLATFORM_DEADLINES = {
    "sessionize": [
        r"(?i)submissions?\s+close[s:]?\s*(\w+\s+\d{1,2},?\s+\d{4})", r"(?i)deadline[:\s]+(\w+\s+\d{1,2},?\s+\d{4})", r"(?i)closes?\s+on\s+(\w+\s+\d{1,2},?\s+\d{4})",
    ],
    "papercall": [
        r"(?i)cfp\s+closes?\s+(\w+\s+\d{1,2},?\s+\d{4})", r"(?i)closes?\s+(\w+\s+\d{1,2},?\s+\d{4})", r"(?i)deadline[:\s]+(\w+\s+\d{1,2},?\s+\d{4})",
    ],
    "pretalx": [
        r"(?i)(?:deadline|cfp\s+end|submissions?\s+until)[:\s]+(\d{4}-\d{2}-\d{2}|\w+\s+\d{1,2},?\s+\d{4})",
    ],
    "eventbrite": [],
}
PLATFORM_CONFIDENCE = {"sessionize": 0.9, "papercall": 0.9, "pretalx": 0.85, "eventbrite": 0.6}
PLATFORM_URL_PART = {
    "sessionize": "sessionize.com", "papercall": "papercall.io", "pretalx": "pretalx", "eventbrite": "eventbrite",
}
SESSIONIZE_EVENT_DATES = r"(?i)event[:\s]+(\w+\s+\d{1,2},?\s+\d{4})\s*[-–]\s*(\w+\s+\d{1,2},?\s+\d{4})"
PAPERCALL_EVENT_DATE = r"(?i)event\s+date[s]?[:\s]+(\w+\s+\d{1,2},?\s+\d{4})"
PAPERCALL_LOCATION = r"(?i)location[:\s]+([^,\n]+(?:,\s*[^,\n]+)?)"
EVENTBRITE_DATE = r"(\w+\s+\d{1,2},?\s+\d{4})"
ONLINE_PATTERN = r"(?i)\b(online|virtual|remote)\b"
ONLINE_OR_HYBRID_PATTERN = r"(?i)\b(online|virtual|remote|hybrid)\b"

# ---- fixed values: speaker-call pages -----------------------------------------------------------
# (pattern, group of the name or 0 for none, group of the duration or 0 for none)
FORMAT_NAME_FIRST = [
    r"(?i)((?:full[- ]?length|standard|regular|breakout)\s*(?:talk|presentation|session)s?)[:\s]*(\d+[-–]?\d*\s*min(?:ute)?s?)?",
    r"(?i)(lightning\s*(?:talk|presentation)s?)[:\s]*(\d+[-–]?\d*\s*min(?:ute)?s?)?",
    r"(?i)(keynote\s*(?:talk|presentation|session)?s?)[:\s]*(\d+[-–]?\d*\s*min(?:ute)?s?)?",
    r"(?i)((?:full[- ]?day\s+)?workshop\s*(?:session)?s?)[:\s]*(\d+[-–]?\d*\s*(?:min(?:ute)?|hour|hr)s?)?",
    r"(?i)(panel\s*(?:discussion|session)?s?)[:\s]*(\d+[-–]?\d*\s*min(?:ute)?s?)?",
    r"(?i)(ignite\s*(?:talk|session)?s?)[:\s]*(\d+[-–]?\d*\s*min(?:ute)?s?)?",
    r"(?i)(deep\s*dive\s*(?:session)?s?)[:\s]*(\d+[-–]?\d*\s*min(?:ute)?s?)?",
    r"(?i)(tech\s*session\s*(?:talk)?s?)[:\s]*(\d+(?:\s*(?:or|and)\s*\d+)?\s*min(?:ute)?s?)?",
]
FORMAT_MIXED_ORDER = [
    r"(?i)(\d+[-–]?\d*)\s*min(?:ute)?s?\s*(talk|presentation|session)s?",
    r"(?i)(talk|presentation|session)s?\s+(?:of\s+)?(\d+(?:\s*(?:or|and)\s*\d+)?)\s*min(?:ute)?s?",
    r"(?i)(\d+[-–]\d+)\s*min(?:ute)?s?\s*\(([^)]+)\)",
    r"(?i)(?:all\s+)?sessions?\s+(?:are|is|will\s+be)\s+(\d+)\s*min(?:ute)?s?",
    r"(?i)(\d+[-–]?\d*)[- ]min(?:ute)?s?\s*(session|talk|presentation)s?",
    r"(?i)(\d+|half)[- ]?(hour|hr|day)\s*(workshop)s?",
    r"(?i)host\s+(\d+[-–]?\d*)[- ]?min(?:ute)?s?\s*(session|talk)s?",
    r"(?i)(?:duration|timeslot)[:\s]+(\d+[-–]?\d*)\s*min",
    r"(?i)(talk|session)s?\s+(?:typically\s+)?run\s+(\d+[-–]?\d*)\s*min",
    r"(?i)(session[ie])\s+di\s+(\d+[-–]?\d*)\s*min",
    r"(?i)(?:sesion[es]*|duración)[:\s]+(?:de\s+)?(\d+)(?:\s*a\s*(\d+))?\s*min",
    r"(?i)(?:can\s+be\s+)?(\d+)(?:\s*(?:or|-|to)\s*(\d+))?\s*min(?:ute)?s?",
    r"(?i)(\d+)[- ]min(?:ute)?s?\s+([A-Z][a-zA-Z\s-]+(?:Talk|Session|Round))",
]
FORMATS_WITHOUT_SECOND_GROUP = [3, 7]  # positions in FORMAT_MIXED_ORDER that capture one group only
FORMAT_ALIASES = {
    "fulllengthpresentation": "Talk", "fulllengthpresentations": "Talk", "fulllengthsession": "Talk",
    "fulllengthsessions": "Talk", "fulllengttalk": "Talk", "fulllengthtalks": "Talk", "standardtalk": "Talk",
    "standardtalks": "Talk", "standardpresentation": "Talk", "standardpresentations": "Talk",
    "standardsession": "Talk", "regulartalk": "Talk", "regulartalks": "Talk", "regularsession": "Talk",
    "breakoutsession": "Breakout Session", "breakoutsessions": "Breakout Session",
    "techsession": "Tech Session", "techsessions": "Tech Session", "lightningtalk": "Lightning Talk",
    "lightningtalks": "Lightning Talk", "lightningpresentation": "Lightning Talk",
    "lightningpresentations": "Lightning Talk", "keynote": "Keynote", "keynotes": "Keynote",
    "keynotetalk": "Keynote", "keynotetalks": "Keynote", "keynotesession": "Keynote",
    "keynotesessions": "Keynote", "workshop": "Workshop", "workshops": "Workshop",
    "workshopsession": "Workshop", "workshopsessions": "Workshop", "fulldayworkshop": "Full-Day Workshop",
    "fulldayworkshops": "Full-Day Workshop", "panel": "Panel", "panels": "Panel", "paneldiscussion": "Panel",
    "paneldiscussions": "Panel", "panelsession": "Panel", "panelsessions": "Panel", "ignite": "Ignite Talk",
    "ignites": "Ignite Talk", "ignitetalk": "Ignite Talk", "ignitetalks": "Ignite Talk",
    "ignitesession": "Ignite Talk", "ignitesessions": "Ignite Talk", "deepdive": "Deep Dive",
    "deepdives": "Deep Dive", "deepdivesession": "Deep Dive", "deepdivesessions": "Deep Dive",
}
ATTENDANCE_PATTERNS = [
    r"(?i)(\d{1,3},\d{3}\+?|\d{4,}\+?)\s*(?:attendees?|participants?|people|developers?|professionals?)",
    r"(?i)(?:approximately|approx\.?|around|about|nearly|over|more\s+than)\s*(\d{3,}(?:,\d{3})*)\s*(?:attendees?|participants?|people|developers?)?",
    r"(?i)(?:expected\s+)?attendance[:\s]+(\d{3,}(?:,\d{3})*\+?)",
    r"(?i)drew\s+(?:nearly\s+)?(\d{1,3},\d{3}|\d{4,})\s*(?:attendees?)?",
    r"(?i)(\d{3,}\+)\s*(?:attendees?|participants?|people|developers?)",
    r"(?i)(?:audience\s+of|capacity\s+of)\s+(\d{3,}(?:,\d{3})*)",
    r"(?i)capacity\s+(?:up\s+to|of)\s+(\d{3,}(?:,\d{3})*)\s*(?:attendees?|participants?|people)?",
    r"(?i)(\d{3,})[- ]person\s+(?:event|conference)",
    r"(?i)(?:aim|expect|target)\s+(?:for\s+)?(\d{3,})\s*(?:attendees?|participants?|people)?",
]
BENEFIT_PATTERNS = {
    "travel": [
        r"(?i)\$\s*(\d+(?:\s*[-–]\s*\d+)?)\s*(?:flight|travel|airfare)",
        r"(?i)travel\s*(?:expenses?)?\s*(?:are\s+)?covered",
        r"(?i)up\s+to\s+\$\s*(\d+)\s*(?:for\s+)?(?:flight|travel)",
        r"(?i)cover(?:ing)?\s+(?:your\s+)?travel",
        r"(?i)travel\s+(?:assistance|support|reimbursement)",
        r"(?i)(?:we\s+)?pay\s+(?:for\s+)?(?:your\s+)?travel",
    ],
    "hotel": [
        r"(?i)(\d+(?:\s*[-–]\s*\d+)?)\s*(?:hotel\s+)?nights?",
        r"(?i)(one|two|three|four|five)\s+(?:hotel\s+)?nights?\s+covered",
        r"(?i)(?:accommodation|hotel|lodging)\s*(?:expenses?)?\s*(?:are\s+)?covered",
        r"(?i)complimentary\s*(?:hotel\s+)?night",
        r"(?i)cover(?:ing)?\s+(?:your\s+)?(?:accommodation|hotel|lodging)",
        r"(?i)(?:we\s+)?provide\s+(?:hotel|accommodation|lodging)",
    ],
    "ticket": [
        r"(?i)free\s+(?:for\s+speakers?|admission|entry|ticket|attendance)",
        r"(?i)complimentary\s+(?:conference\s+)?(?:ticket|pass|entry|attendance)",
        r"(?i)event\s+fee[:\s]+free",
        r"(?i)free[- ]?to[- ]?attend",
        r"(?i)free,?\s+(?:community[- ]?driven\s+)?(?:community\s+)?(?:event|conference)",
        r"(?i)speakers?\s+(?:attend|get\s+in)\s+free",
        r"(?i)free\s+(?:conference\s+)?ticket\s+(?:for\s+)?speakers?",
    ],
    "payment": [
        r"(?i)(?:speakers?\s+)?will\s+be\s+(?:paid|compensated)",
        r"(?i)(?:speaker\s+)?honorarium",
    ],
}
BENEFIT_CAPTURES = {"travel": [0, 2], "hotel": [0, 1]}  # positions of patterns that capture an amount
BENEFIT_VETOES = {
    "travel": [
        r"(?i)(?:not|no|don't|won't|cannot)\s+(?:cover(?:ing)?|provid(?:e|ing)|pay(?:ing)?)\s+(?:any\s+)?travel",
        r"(?i)travel\s+(?:expenses?\s+)?(?:are\s+)?not\s+(?:covered|provided|paid)",
        r"(?i)(?:we're|we\s+are)\s+not\s+covering\s+(?:any\s+)?travel",
    ],
    "hotel": [
        r"(?i)(?:not|no|don't|won't|cannot)\s+(?:cover(?:ing)?|provid(?:e|ing)|pay(?:ing)?)\s+(?:any\s+)?(?:accommodation|hotel|lodging)",
        r"(?i)(?:accommodation|hotel|lodging)\s+(?:expenses?\s+)?(?:are\s+)?not\s+(?:covered|provided|paid)",
    ],
}
AUDIENCE_PATTERNS = [
    r"(?i)(?:attendees?|audience)\s+with\s+(?:at\s+least\s+)?(\d+\+?\s*years?(?:\s+of)?\s+experience)",
    r"(?i)(?:target\s+)?audience[:\s]+([^.]+)",
]
CALL_DATE_PATTERNS = {
    "cfp_opens": r"(?i)Call\s+opens\s+at\s+\d{1,2}:\d{2}\s*[AP]M\s+(\d{1,2}\s+\w{3}\s+\d{4})",
    "cfp_closes": r"(?i)Call\s+closes\s+at\s+\d{1,2}:\d{2}\s*[AP]M\s+(\d{1,2}\s+\w{3}\s+\d{4})",
    "event_date": r"(?i)event\s+date\s+(\d{1,2}\s+\w{3}\s+\d{4})",
    "event_starts": r"(?i)event\s+starts\s+(\d{1,2}\s+\w{3}\s+\d{4})",
    "event_ends": r"(?i)event\s+ends\s+(\d{1,2}\s+\w{3}\s+\d{4})",
}
CALL_LOCATION_PATTERN = r"(?i)location\s+(.+?)(?:\s+website|\s+event\s+(?:date|starts)|We've|🚀|\$)"
CALL_WEBSITE_PATTERN = r"(?i)website\s+([\w.-]+\.[a-z]{2,}(?:/[\w./-]*)?)"
EMAIL_PATTERN = r"[\w.+-]+@[\w-]+\.[\w.-]+"
CALL_CLOSED_PATTERN = r"(?i)call\s+(?:for\s+)?(?:speakers?|papers?|proposals?)\s+is\s+closed"
BOILERPLATE_PATTERNS = [
    r"(?i)^[^:]+:\s*Call for (?:Speakers|Proposals|Papers)\s*@\s*Sessionize\.com\s*",
    r"(?i)Call for (?:Speakers|Proposals|Papers)\s+in\s+\d+\s+(?:days?|months?|hours?)\s*",
    r"(?i)Call (?:opens|closes) in\s+[^.]+timezone\.\s*",
    r"(?i)Closing time in your timezone\s*\([^)]*\)\s*is\s*\.?\s*",
    r"(?i)[A-Z][^(]+\s*\(UTC[+-]\d{2}:\d{2}\)\s*timezone\.?\s*",
    r"(?i)open,?\s+\d+\s+(?:days?|hours?|months?)\s+left\s*",
    r"(?is)Submit a session\s+Login with your preferred account.*$",
    r"(?is)Login with your preferred account.*Classic Login.*$",
    r"(?is)404\s*@\s*Sessionize\.com\s*404\s*Page Not Found.*$",
]
BOILERPLATE_STRINGS = [
    "×Close Classic login Remember me on this computer Login Forgot password? Create new classic account",
    "Download iCalendar file", "(please login first!)", "Add to calendar", "Send to email",
]
VIRTUAL_LOCATIONS = ["online", "virtual", "worldwide", "global", "digital", "remote"]
PHYSICAL_WORDS = ["venue", "on-site", "in person", "in-person", "catering", "lunch", "dinner"]
VIRTUAL_WORDS = ["online event", "virtual event", "join online", "fully online", "virtual conference"]
TRACK_PLACEHOLDERS = ["Select", "Choose", "--"]
MAX_SUBMISSIONS_PATTERN = r"(?i)max(?:imum)?\s*(\d+)\s*(?:submission|proposal)"
COUNTDOWN_PHRASES = [
    "hours ago", "hours left", "hour ago", "hour left", r"in \d+ hour", "finished", "opens at", "closes at",
    "minutes ago", "minutes left",
]
TRAVEL_NEGATIVES = [
    "unable to sponsor", "unable to cover", "not covering travel", "won't cover travel",
    "don't cover travel", "cannot cover travel", "no travel", "travel not", "not able to cover",
]
HOTEL_NEGATIVES = [
    "unable to sponsor", "unable to cover", "not covering hotel", "not covering accommodation",
    "won't cover hotel", "no hotel", "hotel not", "accommodation not",
]
TRAVEL_PHRASES = [
    "travel covered", "cover travel", "travel reimbursement", "travel assistance", "travel support",
    "pay for travel", "flight reimbursement", "airfare covered", "travel expenses covered",
    "reimburse travel",
]
HOTEL_PHRASES = [
    "hotel covered", "accommodation covered", "cover hotel", "cover accommodation", "free accommodation",
    "free hotel", "complimentary hotel", "hotel nights", "nights accommodation", "provide accommodation",
    "provide hotel",
]
FREE_TICKET_PHRASES = [
    "free ticket", "free admission", "free entry", "free attendance", "free for speaker",
    "speakers attend free", "complimentary ticket", "free-to-attend", "free to attend", "free event",
    "free conference",
]

# ---- fixed values: transcripts and tags ---------------------------------------------------------
CAPTION_NOISE = ["[Music]", "[Applause]"]
CANONICAL_TAGS = {
    "test-driven development": "Test-Driven Development (TDD)",
    "test driven development": "Test-Driven Development (TDD)",
    "tdd": "Test-Driven Development (TDD)",
    "test-driven development (tdd)": "Test-Driven Development (TDD)",
    "artificial intelligence": "Artificial Intelligence (AI)", "ai": "Artificial Intelligence (AI)",
    "a.i.": "Artificial Intelligence (AI)", "machine learning": "Machine Learning (ML)",
    "ml": "Machine Learning (ML)", "llm": "Large Language Models (LLM)",
    "llms": "Large Language Models (LLM)", "large language model": "Large Language Models (LLM)",
    "large language models": "Large Language Models (LLM)", "generative ai": "Generative AI",
    "gen ai": "Generative AI", "genai": "Generative AI",
    "ci/cd": "CI/CD", "ci cd": "CI/CD", "continuous integration": "CI/CD", "continuous delivery": "CI/CD",
    "devops": "DevOps", "dev ops": "DevOps", "kubernetes": "Kubernetes", "k8s": "Kubernetes",
    "docker": "Docker", "containerization": "Containers", "containers": "Containers",
    "amazon web services": "AWS", "aws": "AWS", "google cloud": "Google Cloud Platform (GCP)",
    "google cloud platform": "Google Cloud Platform (GCP)", "gcp": "Google Cloud Platform (GCP)",
    "microsoft azure": "Azure", "azure": "Azure",
    "react.js": "React", "reactjs": "React", "react js": "React", "vue.js": "Vue.js", "vuejs": "Vue.js",
    "vue js": "Vue.js", "vue": "Vue.js", "next.js": "Next.js", "nextjs": "Next.js",
    "angular.js": "Angular", "angularjs": "Angular", "node.js": "Node.js", "nodejs": "Node.js",
    "node js": "Node.js", "typescript": "TypeScript", "ts": "TypeScript", "javascript": "JavaScript",
    "js": "JavaScript",
    "rest api": "REST API", "restful api": "REST API", "restful": "REST API", "graphql": "GraphQL",
    "graph ql": "GraphQL", "api design": "API Design", "api development": "API Development",
    "unit testing": "Unit Testing", "integration testing": "Integration Testing",
    "end-to-end testing": "E2E Testing", "e2e testing": "E2E Testing", "e2e": "E2E Testing",
    "microservices": "Microservices", "micro services": "Microservices", "microservice": "Microservices",
    "serverless": "Serverless", "server-less": "Serverless",
    "elasticsearch": "Elasticsearch", "elastic search": "Elasticsearch",
    "full-text search": "Full-Text Search", "search": "Search",
    "postgresql": "PostgreSQL", "postgres": "PostgreSQL", "mysql": "MySQL", "mongodb": "MongoDB",
    "mongo": "MongoDB", "redis": "Redis", "sql": "SQL", "nosql": "NoSQL", "no-sql": "NoSQL",
}

# ---- fixed values: profile links and crawl state ------------------------------------------------
GITHUB_NOT_PROFILE = [
    "github.io", "/sponsors/", "/orgs/", "/marketplace", "/features", "/pricing", "/enterprise", "/topics",
]
GITHUB_GENERIC_PATHS = ["search", "explore", "trending", "collections", "apps"]
RETRYABLE_ERRORS = ["timeout", "connection", "429", "500", "502", "503", "504", "sslerror"]
MAX_RETRIES = 3
RETRY_BACKOFF_HOURS = [1, 6, 24]
FAVICON_PREFIX = "https://www.google.com/s2/favicons?domain="
FAVICON_SUFFIX = "&sz=64"
