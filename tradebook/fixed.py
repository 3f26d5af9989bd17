"""Word lists, lookup tables, constants and patterns that decide results.

Everything here is data, stated plainly and in its natural order; the logic that uses it
lives in the ``functions`` and ``operators`` packages.
"""

# Characters Python's str.strip()/str.split() treat as white space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)
# A run of them as a regular expression (Java syntax).
SPACE_RUN = r"(?U:[\s\x1c-\x1f]+)"

# Full state names and their codes; order matters for prefix matches.
STATE_NAMES = [
    ("ALABAMA", "AL"), ("ALASKA", "AK"), ("ARIZONA", "AZ"), ("ARKANSAS", "AR"),
    ("CALIFORNIA", "CA"), ("COLORADO", "CO"), ("CONNECTICUT", "CT"), ("DELAWARE", "DE"),
    ("FLORIDA", "FL"), ("GEORGIA", "GA"), ("HAWAII", "HI"), ("IDAHO", "ID"),
    ("ILLINOIS", "IL"), ("INDIANA", "IN"), ("IOWA", "IA"), ("KANSAS", "KS"),
    ("KENTUCKY", "KY"), ("LOUISIANA", "LA"), ("MAINE", "ME"), ("MARYLAND", "MD"),
    ("MASSACHUSETTS", "MA"), ("MICHIGAN", "MI"), ("MINNESOTA", "MN"), ("MISSISSIPPI", "MS"),
    ("MISSOURI", "MO"), ("MONTANA", "MT"), ("NEBRASKA", "NE"), ("NEVADA", "NV"),
    ("NEW HAMPSHIRE", "NH"), ("NEW JERSEY", "NJ"), ("NEW MEXICO", "NM"), ("NEW YORK", "NY"),
    ("NORTH CAROLINA", "NC"), ("NORTH DAKOTA", "ND"), ("OHIO", "OH"), ("OKLAHOMA", "OK"),
    ("OREGON", "OR"), ("PENNSYLVANIA", "PA"), ("RHODE ISLAND", "RI"), ("SOUTH CAROLINA", "SC"),
    ("SOUTH DAKOTA", "SD"), ("TENNESSEE", "TN"), ("TEXAS", "TX"), ("UTAH", "UT"),
    ("VERMONT", "VT"), ("VIRGINIA", "VA"), ("WASHINGTON", "WA"), ("WEST VIRGINIA", "WV"),
    ("WISCONSIN", "WI"), ("WYOMING", "WY"),
]
# Codes accepted by validation: the states above plus the district and territories.
VALID_STATES = [code for _, code in STATE_NAMES] + ["DC", "PR", "VI", "GU", "MP", "AS"]

# End-anchored state / ZIP endings of an address line.
STATE_ZIP_END = r"(?i)(?:,\s*)?([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)\s*$"
STATE_END = r"(?i)(?:,\s*)?([A-Za-z]{2})\s*$"
ZIP_END = r"(?:,\s*)?(\d{5}(?:-\d{4})?)\s*$"
# The same with a word boundary before the state or the ZIP.
STATE_ZIP_END_B = r"(?i)(?:,\s*)?\b([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)\s*$"
STATE_END_B = r"(?i)(?:,\s*)?\b([A-Za-z]{2})\s*$"
ZIP_END_B = r"(?:,\s*)?\b(\d{5}(?:-\d{4})?)\s*$"

# Free-text address patterns, as they stand; functions/address.py searches for the same in linear time.
ADDRESS_ZIP = r"(?i)(\d+[^,]+)(?:,|\sin\s)([^,]+),\s*([A-Za-z]{2})\s*(\d{5}(?:-\d{4})?)"
ADDRESS_STATE = r"(?i)(\d+[^,]+)(?:,|\sin\s)([^,]+),\s*([A-Za-z]{2})"
ADDRESS_CITY = r"(?i)(\d+[^,]+)(?:,|\sin\s)([^,]+)"
ADDRESS_ZIP_B = r"(?i)(\d+[^,]+)(?:,|\sin\s)([^,]+),\s*([A-Za-z]{2})\s*(\d{5}(?:-\d{4})?)\b"
ADDRESS_STATE_B = r"(?i)(\d+[^,]+)(?:,|\sin\s)([^,]+),\s*([A-Za-z]{2})\b"

# Field patterns.
ZIP_CODE = r"^\d{5}(-\d{4})?$"
PHONE = r"^\+?1?\d{9,15}$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
WEB_URL = (
    r"^https?:\/\/(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
    r"(?:[-a-zA-Z0-9()@:%_\+.~#?&\/=]*)$"
)
EMAIL_IN_TEXT = r"[\w.\-]+@[\w.\-]+\.\w+\s*"

# Address texts that are no address.
BAD_ADDRESS = [
    r"^\s*$", r"^[0-9\s]*$", r"^unknown$", r"^test",
    r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$", r"^https?://",
    r"^[0-9]{3}-[0-9]{3}-[0-9]{4}$", r"^P\.?O\.?\s*Box", r"^Private\s+Mailbox",
    r"^General\s+Delivery",
]
STREET_TYPES = [
    "street", "avenue", "road", "boulevard", "lane", "drive", "way", "court", "circle",
    "plaza", "square", "parkway", "st", "ave", "rd", "blvd", "ln", "dr", "ct", "cir", "plz",
    "sq", "pkwy",
]
# In alphabetical order: the first term that a name contains is the one reported.
NAME_BLACKLIST = [
    "demo", "dummy", "example", "fake", "n/a", "na", "none", "null", "sample", "test",
    "undefined", "unknown",
]
NAME_KEYWORDS = [
    "inc", "llc", "ltd", "corp", "corporation", "company", "co", "incorporated", "limited",
    "partnership", "associates", "consulting",
]
ALLOWED_DOMAINS = [
    "chamberofcommerce.com", "fda.gov", "yelp.com", "linkedin.com", "ny.gov", "nyc.gov",
    "mapquest.com", "yellowpages.com", "bbb.org", "bloomberg.com", "manta.com",
    "maps.google.com", "google.com",
]
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-y"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
]

# Relevance: (a) name share + keywords + trust tiers.
RELEVANCE_KEYWORDS = ["address", "location", "contact", "business", "company"]
TRUST_TIERS = [
    (0.3, ["bbb.org", "ny.gov", "nyc.gov"]),
    (0.2, ["yelp.com", "yellowpages.com", "chamberofcommerce.com"]),
    (0.1, ["manta.com", "bizapedia.com"]),
]
# (b) weighted keyword groups + trusted domains, first hit wins.
KEYWORD_GROUPS = [
    (0.3, ["business", "company", "corporation", "llc", "inc", "enterprise", "firm",
           "establishment"]),
    (0.2, ["contact", "phone", "email", "fax", "website", "hours", "schedule", "location"]),
    (0.4, ["address", "street", "avenue", "boulevard", "road", "suite", "unit", "floor",
           "building"]),
]
TRUSTED_DOMAINS = [
    ("bbb.org", 0.9), ("yelp.com", 0.8), ("yellowpages.com", 0.8),
    ("chamberofcommerce.com", 0.7), ("manta.com", 0.6), ("bizapedia.com", 0.6),
]
# (c) basic keyword share.
BASIC_KEYWORDS = [
    "address", "location", "business", "new york", "ny", "official", "contact",
    "headquarters", "office", "store",
]
BASIC_DOMAINS = ["ny.gov", "nyc.gov", "bbb.org", "chamberofcommerce.com"]
BASIC_TITLE_TERMS = ["address", "location", "contact"]

# Search query templates; {n} is the business name, {s} the target state.
SITE_QUERIES = [
    "site:yelp.com {n} address", "site:bbb.org {n} business details",
    "site:chamberofcommerce.com {n} company info", "site:yellowpages.com {n}",
    "site:mapquest.com {n}", "site:google.com/maps {n}", "site:manta.com {n} business",
]
BASE_QUERIES = [
    "{n} business address contact", "{n} location headquarters", "{n} store directions",
    "{n} company address", "{n} official address", "{n} main office location",
    "{n} contact us address", "{n} physical location", "{n} store locator",
]
STATE_QUERIES = [
    "{n} {s} address", "{n} {s} location", "site:ny.gov {n} business",
    "site:nyc.gov {n} location", "{n} in {s}",
]
QUOTED_QUERIES = ['"{n}" address', '"{n}" location', '"{n}" contact information']
FALLBACK_TERMS = [
    "business address", "location", "New York", "NY", "official records",
    "contact information",
]
MODEL_QUERY_TERMS = ["business", "company", "address", "location"]
SEARCH_URLS = {
    "chamber": ("+", "https://www.chamberofcommerce.com/search?what=", "&where="),
    "reviews": ("%20", "https://www.trustpilot.com/search?query=", ""),
}
QUERY_PROMPT = (
    "<task>Generate an optimized search query for finding business information.</task>\n"
    "<business>%s</business>\n"
    "<requirements>\n"
    "- Include terms for finding official business records\n"
    "- Focus on physical location and registration info\n"
    "- Target New York state businesses\n"
    "- Include relevant industry keywords\n"
    "- Consider business type and scale\n"
    "</requirements>\n"
    "<format>Return only the search query without any additional text.</format>\n"
    "<query>"
)
SCORE_PROMPT = (
    "<task>Analyze this search result and rate its relevance for finding business "
    "information.</task>\n"
    "<result>\n"
    "Title: %s\n"
    "Description: %s\n"
    "URL: %s\n"
    "</result>\n"
    "<format>Return only a number between 0 and 1 representing relevance score.</format>\n"
    "<score>"
)

# Page extraction.
META_ADDRESS = [
    "place:location:address", "og:street-address", "business:contact_data:street_address",
]
CONTACT_HREF = r"(?i)contact|location|about|find-us"
CONTACT_CLASS = r"(?i)address|location|contact-info"
CHALLENGE_URL_WORDS = [
    "challenge", "captcha", "cf_chl", "cloudflare", "turnstile", "cf-please-wait",
]
CHALLENGE_PHRASES = [
    "checking if the site connection is secure", "checking your browser", "please wait...",
    "please stand by", "verify you are a human", "enable javascript and cookies",
    "please enable cookies", "one more step", "please verify you are a human",
    "just a moment", "security check to access", "i am human", "i am not a robot",
    "human verification",
]
CHALLENGE_MARKUP = [
    r"<iframe[^>]*\ssrc\s*=\s*[\"']?[^\"'>]*challenges",
    r"<[a-z][^>]*\sid\s*=\s*[\"']?(?:challenge-form|challenge-running|cf-please-wait|"
    r"turnstile-wrapper|cf-content|cf_challenge-stage)[\"'\s>]",
    r"<[a-z][^>]*\sdata-translate\s*=\s*[\"']?challenge[\"'\s>]",
    r"<[a-z][^>]*\sclass\s*=\s*(?:\"[^\"]*cf-|'[^']*cf-|[^\"'\s>]*cf-)",
]
# A page without any of these holds none of the markup above.
CHALLENGE_MARKUP_WORDS = ["challenge", "cf-", "turnstile-wrapper"]
NO_RESULT_PHRASES = [
    "no results found", "we couldn't find any results", "try adjusting your search",
    "0 results", "nothing matches", "no matches found",
]
RESULT_CLASSES = [
    "search-results", "business-listing", "search-result", "listing-item", "result-item",
]
CONTENT_MARKERS = [
    "business-listing", "search-results", "address", "location", "contact-info",
    "business-card", "company-info", "search-result", "business-unit",
]
BLOCK_STATUS = [401, 403, 429]
WATCHED_DOMAINS = ["chamberofcommerce.com", "trustpilot.com"]
DIRECTORY_SELECTORS = [
    "address.card-text", "div.address", ".business-address", "[itemprop='address']",
    ".listing-address",
]
REVIEW_SELECTORS = [
    "address>ul>li>ul", "address ul", "address li", "address",
    "[data-business-unit-location]", "div[data-initial-business-info]",
    ".business-info-address", ".address-info", "[data-address]",
    ".company-information address", ".contact-info address", ".location-info",
    ".business-location",
]
SELECTOR_ATTRIBUTES = ["data-address", "data-location", "title"]
# (tag or *, attribute or None, "contains"/"equals", value, ancestor rule or None)
ADDRESS_CLASS_PATTERNS = [
    ("div", "class", "contains", "address", None),
    ("div", "class", "contains", "location", None),
    ("div", "class", "contains", "contact", None),
    ("div", "id", "contains", "address", None),
    ("div", "id", "contains", "location", None),
    ("address", None, None, None, None),
    ("div", "itemtype", "contains", "PostalAddress", None),
    ("*", "itemprop", "equals", "address", None),
    ("*", "itemprop", "equals", "streetAddress", None),
    ("*", "typeof", "equals", "PostalAddress", None),
    ("div", "class", "contains", "business-info", None),
    ("div", "class", "contains", "store-info", None),
    ("address", None, None, None, ("footer", None, None, None)),
    ("address", None, None, None, ("div", "class", "contains", "footer")),
]

# Events, alerts, limits.
HIGH_EVENTS = [
    "ERROR", "NODE_DOWN", "RECOVERY_FAILED", "MIGRATION_FAILED", "REBALANCE_FAILED",
]
MEDIUM_EVENTS = [
    "WARNING", "MIGRATION_START", "MIGRATION_COMPLETE", "REBALANCE_START",
    "REBALANCE_COMPLETE", "RECOVERY_START", "RECOVERY_COMPLETE", "BACKUP", "RESTORE",
    "THRESHOLD_EXCEEDED",
]
SEVERITIES = ["error", "warning", "info"]
METRIC_PREFIXES = {
    "cache": "cache", "database": "db", "system": "sys", "network": "net", "error": "error",
}
SENSITIVE_WORDS = ["password", "secret", "token", "key", "auth", "credential", "private"]
# rule -> (requests, period seconds, penalty seconds)
RATE_RULES = {"default": (60, 60, 300), "search": (30, 60, 600), "scrape": (10, 60, 900)}
# name, severity, message template, template columns
HEALTH_RULES = [
    ("system_availability", "critical",
     "System availability is below 90%%: Current availability: %.2f%%", ["availability"]),
    ("unhealthy_nodes", "critical",
     "Too many unhealthy nodes: %d/%d nodes are healthy", ["healthy_nodes", "total_nodes"]),
    ("high_latency", "warning",
     "High system latency detected: Average latency is %.2fms", ["avg_latency"]),
    ("error_rate", "warning",
     "High error rate detected: Error rate is %.2f%%", ["error_rate"]),
]
BUSINESS_COLUMNS = ["id", "business_name", "address", "state", "zip_code", "created_at"]
DISPLAY_DATE_COLUMNS = [
    "created_at", "updated_at", "nsl_published_date", "nsl_effective_date", "remediated_date",
]
