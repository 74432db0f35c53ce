"""FIXED VALUES: word lists, phrases and patterns that decide results.

They are plain data that other systems reading the same messages rely on, so
they are stated literally and kept in one place. Matching is loose by design
("owe" is found in "flower"); do not repair them here.
"""

# -- money ------------------------------------------------------------------
AMOUNT_PATTERN = (
    r"\$[\d,]+(?:\.\d{1,2})?"
    r"|\b\d+\s*\$"
    r"|\b\d+\s*(?:dollars?|bucks?)\b"
)

PAYMENT_APP_WORDS = ["venmo", "cashapp", "cash app", "zelle", "apple pay", "paypal"]
BILL_SPLIT_WORDS = ["split", "halves", "half", "divide", "chip in", "go dutch"]
DEBT_WORDS = [
    "owe", "owed", "pay me back", "pay back", "pay you back",
    "where's my money", "my money back", "pay me",
]
DIRECT_AMOUNT_WORDS = ["$", "dollars", "bucks"]

OFFER_PHRASES = [
    "i owe", "i'll pay", "i'll send", "let me pay", "let me send",
    "i can pay", "i can send", "i'll venmo", "i'll cashapp", "i'll zelle",
    "shall i send", "should i send", "want me to send", "want me to pay",
    "do i owe", "how much do i owe", "i need to pay", "paying you",
    "send you", "pay you back", "i'll cover", "let me cover",
    "i got you", "my treat", "i'll get this", "on me",
    "sending you", "lemme pay", "lemme send", "ima send", "ima pay",
    "lemme venmo", "lemme cashapp", "lemme zelle",
    "venmo you", "cashapp you", "zelle you",
    "i'll get you", "let me get you", "i'll take care of",
]
SPLIT_PHRASES = [
    "split", "halves", "half", "divide", "each", "chip in", "go dutch", "share the",
]

# -- contact ----------------------------------------------------------------
PHONE_US_PATTERN = r"(?:\+?1[\s\-\.]?)?\(?\d{3}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{4}"
PHONE_IN_PATTERN = r"(?:\+?91[\s\-]?)?[6-9]\d{4}[\s\-]?\d{5}"
PHONE_STOP_WORDS = [
    "card", "credit", "debit", "order", "tracking", "invoice",
    "pin", "passport", "zip", "room", "flight", "ticket",
    "build", "version", "score", "year",
]

# -- alarm / calendar -------------------------------------------------------
TIME_WORDS = [
    "tomorrow", "tmrw", "today", "tonight", "yesterday",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "mon", "tue", "tues", "wed", "thu", "thurs", "fri", "sat", "sun",
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "january", "february", "march", "april", "june", "july", "august",
    "september", "october", "november", "december",
    "noon", "midnight", "morning", "afternoon", "evening", "night",
    "am", "pm", "a.m.", "p.m.",
    "hour", "hours", "hr", "hrs", "min", "mins", "minute", "minutes",
    "week", "weeks", "weekend", "month", "months",
    "next", "this", "last",
]
DURATION_PATTERN = r"\bin\s+(\d+)\s*(min|mins|minutes|hour|hours|hr|hrs)\b"
ALARM_VERBS = [
    "remind me to ", "remind me ", "set a reminder to ",
    "set a reminder for ", "set an alarm for ", "set an alarm to ",
    "set alarm for ", "wake me up ", "wake me ",
    "ping me at ", "ping me in ", "ping me when ",
    "notify me at ", "alert me at ", "buzz me at ",
    "don't let me forget to ", "note to self ",
    "reminder: ",
]
LABEL_TAIL_AT = r"\bat\s*$"
LABEL_TAIL_DURATION = r"\bin\s+\d+\s*(min\w*|hour\w*|hr\w*)\s*$"
CALENDAR_PREFIXES = [
    "schedule a meeting ", "schedule ", "let's schedule ",
    "put ", "add ", "book ", "block my calendar ", "block off ",
    "pencil me in ", "save the date ", "save the date for ",
]
TITLE_TAIL = r"\b(at|on|for|to|from)\s*$"
TITLE_LEAD = r"^\s*(hey|yo|btw|fyi|ok so|so|also|wait)\s+"
SHORT_EVENT_PATTERN = r"\b(meeting|call|sync|standup|1:1|interview)\b"

# -- maps -------------------------------------------------------------------
PLACE_VERBS = [
    "meet me at ", "lets meet at ", "let's meet at ", "meet at ", "meet you at ",
    "see u at ", "see you at ", "catch you at ", "meet up at ",
    "come to ", "come meet me at ",
    "i'm at ", "im at ", "i am at ", "currently at ",
    "im parked at ", "waiting at ", "hanging at ", "chilling at ",
    "i'm inside ", "im inside ", "we're at ", "we are at ",
    "heading to ", "on my way to ", "omw to ", "driving to ",
    "pulling up to ", "pulling into ", "headed over to ", "going to ",
    "making my way to ", "en route to ",
    "directions to ", "how do i get to ", "navigate to ", "map me to ",
    "open ", "find ", "pull up ",
    "the address is ", "spot is ", "address for ", "venue is ",
    "here's the address ", "event location: ", "event location is ",
]
PLACE_FALLBACK_PATTERN = (
    r"\b(?:at|to|from)\s+(.+?)"
    r"(?:\s+(?:at|tomorrow|today|tonight|tmrw|mon|tue|wed|thu|fri|sat|sun)\b|$)"
)

# -- targeting --------------------------------------------------------------
NAMES = [
    "akash", "rohit", "priya", "samyak", "nikhil", "aditi", "aunty", "uncle",
    "mom", "dad", "sarah", "mike", "john", "emma", "alex", "chris",
    "jessica", "brian", "kevin", "amanda", "rachel", "dave", "meera",
    "kiran", "anjali", "sid", "rohan", "neha",
]
ADDRESSEE_PATTERN = r"(?:^|\s)(?:hey|yo|ok|@)\s*@?([A-Za-z]{2,})\b"
LEADING_NAME_PATTERN = r"^\s*([A-Za-z]{2,})[,:]"
MUTUAL_PATTERN = (
    r"\b(?:everyone|everybody|y'?all|guys|team|squad|group|all\s+of\s+us|"
    r"we|we're|us\s+all|the\s+whole\s+team|entire\s+team|full\s+team)\b"
)
SELF_PHRASES = [
    "remind me", "ping me", "wake me", "buzz me", "notify me", "alert me",
    "i need ", "i'll ", "ima ", "imma ", "myself", "i have to ", "i gotta ",
    "note to self", "my number", "my cell", "my alarm", "my calendar",
]

# -- keyword scorer ---------------------------------------------------------
INTENT_KEYWORDS = {
    "money": [
        "$", " money", "venmo", "cashapp", "zelle", "owe", "pay me", "pay up",
        "split", "bucks", "dollar", "send me", "paypal",
    ],
    "alarm": [
        "remind me", "reminder", "wake me", "wake up", "set alarm", "set an alarm",
        "ping me in", "in 20 min", "in 2 hour", "notify me", "alert me",
        "don't let me forget", "note to self",
    ],
    "contact": [
        "save this number", "save his number", "save her number", "save my number",
        "save contact", "add to contacts", "add contact", "here's my number",
        "heres my number", "call me at", "here's the number", "this is ", "my number",
        "number is", "+1 ", "+91 ",
    ],
    "calendar": [
        "meeting", "team sync", "standup", "1:1", "dinner ", "lunch ", "coffee ",
        "schedule", "block off", "pencil me in", "save the date", "wedding",
        "gym ",
    ],
    "maps": [
        "meet me at ", "meet at ", "meet you at ", "i'm at ", "im at ", "currently at",
        "heading to ", "omw to ", "directions to ", "navigate to ", "pull up ",
        "the address is", "address for",
    ],
}
KEYWORD_HIT, KEYWORD_MISS = 0.99, 0.01

# -- text augmentation ------------------------------------------------------
AUGMENT_PREFIXES = ["hey ", "yo ", "btw ", "fyi ", "ok so ", "so ", "also ", "wait "]
AUGMENT_SUFFIXES = [
    " lol", " haha", " fr", " ngl", " tbh", " tho", " rn", " asap", " plz", " pls",
]
AUGMENT_ODDS = {"lower": 0.3, "upper": 0.1, "prefix": 0.3, "suffix": 0.25, "typo": 0.1}

# -- links ------------------------------------------------------------------
PAY_URL = "https://venmo.com/?txn=pay"
CALENDAR_URL = "https://calendar.google.com/calendar/u/0/r/eventedit"
MAPS_URL = "https://www.google.com/maps/search/?api=1&query="
SUMMARY_ORDER = {"money": 1, "alarm": 2, "calendar": 3, "contact": 4, "maps": 5}
