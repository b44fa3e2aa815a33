"""Ordered rule tables.  The order decides which rule wins."""

from __future__ import annotations

# --- fixed values: subscription keyword -> display name ----------------------
SUBSCRIPTION_RULES = [
    ("netflix", "Netflix"), ("spotify", "Spotify"), ("youtube", "YouTube"),
    ("youtubepremium", "YouTube Premium"), ("disney", "Disney+"), ("hulu", "Hulu"),
    ("hbo", "HBO Max"), ("paramount", "Paramount+"), ("peacock", "Peacock"),
    ("crunchyroll", "Crunchyroll"), ("apple music", "Apple Music"), ("apple tv", "Apple TV+"),
    ("amazon prime", "Amazon Prime"), ("audible", "Audible"), ("tidal", "Tidal"),
    ("deezer", "Deezer"), ("pandora", "Pandora"), ("icloud", "iCloud"),
    ("google one", "Google One"), ("google storage", "Google Storage"), ("dropbox", "Dropbox"),
    ("microsoft 365", "Microsoft 365"), ("office 365", "Office 365"), ("adobe", "Adobe"),
    ("canva", "Canva"), ("playstation", "PlayStation"), ("xbox", "Xbox"),
    ("nintendo", "Nintendo"), ("steam", "Steam"), ("chatgpt", "ChatGPT"),
    ("openai", "OpenAI"), ("notion", "Notion"), ("grammarly", "Grammarly"),
    ("duolingo", "Duolingo"), ("headspace", "Headspace"), ("calm", "Calm"),
    ("tinder", "Tinder"), ("bumble", "Bumble"), ("flow", "Flow"), ("digicel", "Digicel"),
]

SUBSCRIPTION_RULES_WIDE = [
    ("netflix", "Netflix"), ("spotify", "Spotify"), ("youtube", "YouTube"),
    ("youtubepremium", "YouTube Premium"), ("disney", "Disney+"), ("hulu", "Hulu"),
    ("hbo", "HBO Max"), ("paramount", "Paramount+"), ("peacock", "Peacock"),
    ("crunchyroll", "Crunchyroll"), ("apple music", "Apple Music"), ("apple tv", "Apple TV+"),
    ("amazon prime", "Amazon Prime"), ("audible", "Audible"), ("tidal", "Tidal"),
    ("deezer", "Deezer"), ("pandora", "Pandora"), ("icloud", "iCloud"),
    ("google one", "Google One"), ("google storage", "Google Storage"), ("dropbox", "Dropbox"),
    ("microsoft 365", "Microsoft 365"), ("office 365", "Office 365"), ("adobe", "Adobe"),
    ("canva", "Canva"), ("playstation", "PlayStation"), ("xbox", "Xbox"),
    ("nintendo", "Nintendo"), ("steam", "Steam"), ("ea play", "EA Play"),
    ("epic games", "Epic Games"), ("chatgpt", "ChatGPT"), ("openai", "OpenAI"),
    ("notion", "Notion"), ("evernote", "Evernote"), ("grammarly", "Grammarly"),
    ("duolingo", "Duolingo"), ("headspace", "Headspace"), ("calm", "Calm"),
    ("tinder", "Tinder"), ("bumble", "Bumble"), ("flow", "Flow"), ("digicel", "Digicel"),
    ("jps", "JPS"), ("nwc", "NWC"), ("lampa", "Lampa"),
]

# --- fixed values: upper-case statement phrase -> category -------------------
TRANSACTION_RULES = [
    ("POS PURCHASE", "shopping"),
    ("ABM WITHDRAWAL", "atm_withdrawal"),
    ("ATM WITHDRAWAL", "atm_withdrawal"),
    ("FUNDS TRANSFER FROM", "transfer"),
    ("FUNDS TRANSFER TO", "transfer"),
    ("FUNDS TRANSFER", "transfer"),
    ("ITB-CUSTOMER TRAN", "transfer"),
    ("THIRD PARTY TRF", "transfer"),
    ("BILL PAYMENT", "utilities"),
    ("LOAN PAYMENT", "loan_payment"),
    ("MORTGAGE", "loan_payment"),
    ("INSURANCE", "insurance"),
]

# --- fixed values: vendor keyword -> category --------------------------------
VENDOR_RULES = [
    ("knutsford", "transport"), ("uber", "transport"), ("lyft", "transport"),
    ("bolt", "transport"), ("taxi", "transport"), ("shell", "transport"),
    ("texaco", "transport"), ("rubis", "transport"),
    ("juici", "dining"), ("kfc", "dining"), ("burger king", "dining"),
    ("mcdonalds", "dining"), ("dominos", "dining"), ("pizza", "dining"),
    ("restaurant", "dining"), ("minimart", "dining"), ("food", "dining"),
    ("bakery", "dining"), ("cafe", "dining"), ("grill", "dining"),
    ("patties", "dining"), ("island grill", "dining"),
    ("supermarket", "groceries"), ("hi-lo", "groceries"), ("pricesmart", "groceries"),
    ("megamart", "groceries"),
    ("jps", "utilities"), ("jamaica public service", "utilities"), ("nwc", "utilities"),
    ("national water", "utilities"),
    ("pharmacy", "health"), ("hospital", "health"), ("medical", "health"),
    ("uwi", "education"), ("university", "education"),
    ("rent", "rent"), ("landlord", "rent"),
]

VENDOR_RULES_WIDE = [
    ("knutsford", "transport"), ("uber", "transport"), ("lyft", "transport"),
    ("bolt", "transport"), ("taxi", "transport"), ("gas station", "transport"),
    ("shell", "transport"), ("texaco", "transport"), ("total", "transport"),
    ("rubis", "transport"),
    ("juici", "dining"), ("kfc", "dining"), ("burger king", "dining"),
    ("mcdonalds", "dining"), ("dominos", "dining"), ("pizza", "dining"),
    ("restaurant", "dining"), ("minimart", "dining"), ("food", "dining"),
    ("bakery", "dining"), ("cafe", "dining"), ("grill", "dining"),
    ("patties", "dining"), ("island grill", "dining"),
    ("supermarket", "groceries"), ("hi-lo", "groceries"), ("pricesmart", "groceries"),
    ("shoppers fair", "groceries"), ("megamart", "groceries"), ("progressive", "groceries"),
    ("loshusan", "groceries"), ("general food", "groceries"),
    ("jps", "utilities"), ("jamaica public service", "utilities"), ("nwc", "utilities"),
    ("national water", "utilities"), ("flow", "utilities"), ("digicel", "utilities"),
    ("lime", "utilities"),
    ("pharmacy", "health"), ("hospital", "health"), ("clinic", "health"),
    ("doctor", "health"), ("medical", "health"), ("dental", "health"),
    ("uwi", "education"), ("university", "education"), ("school", "education"),
    ("college", "education"),
    ("rent", "rent"), ("landlord", "rent"),
]

# --- fixed values: categories and phrases used by several operators ----------
EXPENSE_CATEGORIES = ["utilities", "loan_payment", "insurance", "rent"]
FEE_PHRASES = ["SERVICE CHARGE", "GCT/GOVT TAX", "GCT TAX"]
NO_CONTINUATION_PHRASES = ["SERVICE CHARGE", "GCT"]
PAUSABLE_CATEGORIES = ["entertainment", "gaming"]

# --- fixed values: exam keywords, first one found is reported ----------------
EXAM_KEYWORDS = [
    "exam", "test", "quiz", "final", "midterm", "mid-term", "assessment", "assignment due",
    "project due", "submission", "presentation", "defense", "defence", "lab practical", "viva",
]

# --- fixed values: calendar-event vocabularies -------------------------------
TRAVEL_KEYWORDS = [
    "flight", "fly", "flying", "airport", "airline", "boarding",
    "vacation", "holiday", "trip", "travel", "cruise", "sailing",
    "hotel", "hostel", "airbnb", "resort", "check-in", "checkin",
    "departure", "arrival", "layover", "connecting", "transit",
    "passport", "visa", "immigration", "customs",
    "suitcase", "luggage", "pack", "packing",
    "abroad", "overseas", "international", "foreign",
    "relocat", "moving to", "moving day",
    "study abroad", "exchange program", "semester abroad",
    "backpacking", "road trip", "safari", "trek", "hiking",
    "honeymoon", "babymoon", "getaway", "retreat",
    "missionary", "deployment", "posting",
]
LOCAL_KEYWORDS = [
    "meeting", "standup", "scrum", "sync", "review", "retro",
    "appointment", "checkup", "cleaning", "exam",
    "gym", "yoga", "crossfit", "workout", "practice", "training",
    "lunch", "dinner", "brunch", "coffee", "date night",
    "lecture", "class", "lab", "tutorial", "study group",
    "haircut", "barber", "salon",
    "bill", "payment", "due", "renewal", "subscription",
    "pick up", "drop off", "delivery",
    "church", "choir", "bible study", "service",
    "vet", "dentist", "doctor", "therapy", "counseling",
    "plumber", "electrician", "maintenance", "repair",
]
AIRPORT_CODES = [
    "MBJ", "KIN", "JFK", "LAX", "ORD", "ATL", "MIA", "FLL",
    "YYZ", "LHR", "CDG", "NRT", "DXB", "SIN", "HKG",
    "PTY", "NAS", "POS", "BGI", "ANU", "GCM", "PUJ", "CUN",
    "HAV", "SJU", "SDQ", "SFO", "BOS", "IAH", "DFW", "SEA",
    "DEN", "MCO", "EWR", "IAD", "PHL", "MSP", "DTW", "CLT",
]
FLIGHT_WORDS = ["flight", "fly", "flying", "airline"]
FOREIGN_COUNTRIES = [
    "usa", "uk", "canada", "england", "france", "spain", "japan", "germany", "australia",
    "mexico", "brazil", "cuba", "haiti", "trinidad", "bahamas", "barbados", "antigua", "cayman",
]
ACCOMMODATION_WORDS = ["hotel", "hostel", "airbnb", "resort", "villa", "rental"]
TRAVEL_DOCUMENT_WORDS = ["passport", "visa", "immigration", "customs", "boarding pass"]
TRIGGER_GROUPS = [
    ("travel", ["flight", "fly", "airport", "airline"]),
    ("vacation", ["vacation", "holiday", "cruise", "resort", "honeymoon", "getaway"]),
    ("study", ["study abroad", "exchange", "semester", "university", "orientation"]),
    ("work", ["work", "conference", "business", "internship", "office", "client"]),
    ("relocation", ["relocat", "moving", "permanent"]),
    ("medical", ["hospital", "surgery", "medical", "treatment", "rehab"]),
]
VIRTUAL_LOCATION_WORDS = ["zoom", "teams", "online", "home", "office", "n/a", "email"]

# --- fixed values: search phrase per location type and keyword ---------------
ALTERNATIVE_SEARCH_TERMS = {
    "physical": [
        ("gym", "gyms with day passes or short-term memberships"),
        ("fitness", "gyms with day passes or short-term memberships"),
        ("pool", "public pools or pool day passes"),
        ("parking", "parking options"),
        ("club", "similar clubs or social venues"),
        ("yoga", "yoga studios with drop-in classes"),
        ("crossfit", "CrossFit gyms with drop-in rates"),
        ("studio", "fitness studios with day passes"),
        ("cowork", "coworking spaces with day passes"),
        ("workspace", "coworking spaces with day passes"),
        ("storage", "short-term storage facilities"),
    ],
    "regional_service": [
        ("data", "prepaid SIM cards or mobile data plans for visitors"),
        ("flow", "prepaid SIM cards or mobile data plans for visitors"),
        ("digicel", "prepaid SIM cards or mobile data plans for visitors"),
        ("mobile", "prepaid SIM cards or eSIM data plans for visitors"),
        ("cell", "prepaid SIM cards or mobile data plans for visitors"),
        ("internet", "short-term internet or WiFi options"),
        ("cable", "streaming alternatives"),
        ("tv", "streaming alternatives"),
    ],
}
