"""Reference lists: brands, wording, providers, file kinds.

Fixed values: these lists, patterns, numbers and names decide which mails are flagged, so they are
stated here as they must be. The organisation, its partners and the blocklist entries are own,
invented examples under reserved domains; a deployment replaces them.
"""

from __future__ import annotations

# --- domains -------------------------------------------------------------------------------------
MULTI_PART_SUFFIXES = ["co.uk", "org.uk", "com.au", "com.pl", "org.pl", "net.pl", "gov.pl", "edu.pl", "waw.pl"]

ORG_DOMAIN = "corvane-freight.example"
APPROVED_LOGINS = [
    "login.corvane-freight.example",
    "mail.corvane-freight.example",
    "files.corvane-freight.example",
    "hr.corvane-freight.example",
]

# Free-mail providers as the signal rules know them, and the shorter list that campaign matching uses.
FREEMAIL = [
    "gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com", "yahoo.com", "icloud.com",
    "proton.me", "protonmail.com", "gmx.com", "wp.pl", "onet.pl", "o2.pl", "interia.pl", "op.pl",
    "freemail.test",
]
CAMPAIGN_FREEMAIL = [
    "gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "proton.me",
    "protonmail.com", "wp.pl", "o2.pl", "onet.pl", "interia.pl", "gazeta.pl", "poczta.fm",
]
SHORTENERS = [
    "bit.ly", "bitly.com", "tinyurl.com", "t.co", "is.gd", "v.gd", "ow.ly", "cutt.ly", "goo.gl",
    "buff.ly", "rebrand.ly", "tiny.cc", "shorturl.at", "rb.gy", "bl.ink", "t.ly", "s.id", "lnkd.in",
    "qr.ae", "adf.ly", "shorte.st", "tiny.one", "short.gy", "urlz.fr", "x.co", "y2u.be",
]
CAMPAIGN_SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "is.gd", "ow.ly", "cutt.ly", "rb.gy"]
SHOWN_TLDS = [
    "com", "net", "org", "info", "biz", "io", "co", "app", "dev", "eu", "pl", "de", "uk",
    "fr", "nl", "es", "us", "ru", "cn", "me", "ly", "gl", "be", "ch", "at", "cz", "se",
    "no", "dk", "fi", "ie", "pt", "ca", "au", "jp", "gov", "edu", "online", "site", "xyz",
    "top", "live", "shop", "cloud", "tech", "store", "example", "test",
]
DEMO_TLDS = [".example", ".test"]

# --- brands: (key, name, keywords, domains) ------------------------------------------------------
BRANDS = [
    ("microsoft", "Microsoft",
     ["microsoft", "office 365", "office365", "microsoft 365", "o365", "m365", "onedrive",
      "sharepoint", "outlook team", "outlook support", "outlook account", "outlook web app"],
     ["microsoft.com", "office.com", "office365.com", "microsoftonline.com", "microsoft365.com",
      "sharepoint.com", "onedrive.com", "live.com", "outlook.com", "microsoft.example"]),
    ("company", "Corvane Freight",
     ["corvane freight", "corvane it", "corvane hr", "it helpdesk", "it help desk", "it support",
      "it security", "it department", "hr portal", "hr department", "payroll"],
     ["corvane-freight.example"]),
    ("google", "Google", ["google", "gmail", "google drive", "google workspace"],
     ["google.com", "google.pl", "gmail.com", "googlemail.com"]),
    ("pko", "PKO Bank Polski", ["pko", "pko bp", "pko bank polski", "ipko"], ["pkobp.pl", "ipko.pl"]),
    ("dhl", "DHL", ["dhl"], ["dhl.com", "dhl.pl", "dhl.de"]),
    ("inpost", "InPost", ["inpost", "paczkomat", "paczkomaty"], ["inpost.pl", "inpost.eu", "inpost.co.uk"]),
    ("swiftbox", "SwiftBox", ["swiftbox", "swift box"], ["swiftbox.example"]),
    ("inkwell", "Inkwell Supplies", ["inkwell", "inkwell supplies"], ["inkwell-supplies.example"]),
]

# --- known bad indicators ------------------------------------------------------------------------
BLOCKLIST_UPDATED = "2024-01-01"
BLOCKLIST_DOMAINS = ["esign-vault.test", "invoice-gate-pay.test", "cheap-pills.example.com", "spam-farm.example.org"]
BLOCKLIST_URLS = ["HTTP://Files.Quickdrop.test/get/7/"]
BLOCKLIST_SENDERS = ["Billing.Desk@freemail.test"]
BLOCKLIST_IPS = ["192.0.2.66", "203.0.113.51", "not-an-address"]

# --- sender claims -------------------------------------------------------------------------------
ROLE_ACRONYMS = ["CEO", "CFO", "COO", "CTO", "CIO", "IT", "HR"]
ROLE_PHRASES = [
    "chief executive", "chief financial", "chief operating", "managing director",
    "director", "president", "head of", "finance department", "finance team",
    "accounts payable", "accounting", "human resources", "helpdesk", "help desk",
    "administrator",
]

# --- wording: category -> phrases and patterns ---------------------------------------------------
CONTENT_PHRASES = {
    "urgency": [
        "urgently", "immediately", "as soon as possible", "right away", "act now",
        "final notice", "final warning", "last warning", "final reminder", "legal action",
        "will be suspended", "will be deactivated", "will be disabled", "will be locked",
        "will be closed", "will be deleted", "will be terminated", "will be blocked",
        "lose access", "losing access", "unusual activity", "unusual sign-in activity",
        "unusual login activity", "suspicious activity", "suspicious sign-in", "unauthorized access",
    ],
    "credential_request": [
        "verify your account", "verify your identity", "verify your email", "verify your login",
        "verify your password", "verify your details", "verify immediately", "verify now",
        "confirm your account", "confirm your identity", "confirm your login", "confirm your password",
        "confirm your credentials", "update your credentials", "update your password", "update your login",
        "re-enter your password", "re-enter your login", "re-enter your credentials", "enter your password",
        "validate your account", "reactivate your account", "unlock your account",
        "sign in to keep", "sign in to verify", "sign in to confirm", "log in to verify", "log in to confirm",
    ],
    "payment_change": [
        "updated bank details", "new bank details", "changed bank details", "change of bank details",
        "change of bank account", "bank details have changed", "bank details have been updated",
        "bank details have been changed", "bank account has changed", "bank account has been changed",
        "bank account has been updated", "new bank account", "changed our bank", "changed our account",
        "do not use the old account", "do not pay to the old account", "old account is no longer",
        "no longer use the old account", "updated iban", "new iban", "updated banking details",
        "new banking details",
    ],
    "gift_card": [
        "gift card", "gift cards", "gift voucher", "gift vouchers", "google play card", "google play cards",
        "itunes card", "itunes cards", "apple card", "apple cards", "amazon voucher", "amazon vouchers",
        "steam card", "steam cards", "paysafecard", "scratch off the code", "scratch the back",
    ],
    "mfa_code_request": [
        "read me the code", "tell me the code", "send me the verification code", "send me the security code",
        "6-digit code", "six-digit code", "one-time code", "one-time password",
        "approve all of them", "approve all prompts", "approve all the prompts", "approve all requests",
        "approve every prompt", "approve the prompts", "approve the sign-in request", "approve the login request",
        "accept all prompts",
    ],
}
CONTENT_PATTERNS = {
    "urgency": [
        r"(?<!not\s)\burgent\b",
        r"(?<!no\s)\baction\s+required\b",
        r"\bwithin\s+\d+\s+(?:hours?|minutes?)\b",
        r"\b(?:expires?|expiring|deactivated|suspended|disabled|locked|closed|deleted|returned|blocked)\s+(?:in|within)\s+\d+\s+(?:hours?|minutes?)\b",
    ],
    "credential_request": [
        r"\b(?:sign|log)[\s-]*in\s+(?:here|now|below|at\s+https?://)",
        r"\b(?:sign|log)[\s-]*in\s+with\s+your\s+(?:work\s+|company\s+|office\s+|microsoft\s+)?(?:email|account|password|credentials)\b",
        r"\b(?:sign|log)[\s-]*in\s+with\s+the\s+account\s+details\b",
    ],
    "payment_change": [
        r"\b(?:pay|transfer|send|remit)\b[^.\n]{0,60}?\bto\s+(?:the|our)\s+new\s+(?:bank\s+)?account\b",
        r"\b(?:new|updated|changed|different)\b[^.\n]{0,80}?(?-i:\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}\b)",
    ],
    "gift_card": [],
    "mfa_code_request": [
        r"\b(?:send|give|text|forward)\s+(?:me|us)\s+(?:the|that|this)\s+code\b(?!\s+(?:review|snippet|changes?|sample|files?|for))",
        r"\b(?:verification|security|login|sign-in|authentication|mfa|2fa|one-time)\s+codes?\s+(?:you\s+received|we\s+(?:just\s+)?sent|sent\s+to\s+your)",
    ],
}
# Words of which each text that a pattern above matches holds at least one.
CONTENT_PATTERN_WORDS = {
    "urgency": ["urgent", "required", "hour", "minute"],
    "credential_request": ["sign", "log"],
    "payment_change": ["account", "new", "updated", "changed", "different"],
    "gift_card": [],
    "mfa_code_request": ["code"],
}
CONTENT_SEVERITY = {
    "urgency": 2, "credential_request": 2, "payment_change": 3, "gift_card": 3, "mfa_code_request": 3,
}
MONEY_WORDS = ["iban", "bank account", "bank details", "new bank", "invoice", "payment", "faktur", "numer konta", "przelew"]

# Words in a link's path that belong to sign-in and "confirm your details" pages.
LOGIN_PATH = "log-?in|sign-?in|sign-?on|verif(?:y|ication)|account|password|passwd|secure|update|confirm"
# A password handed over in the mail itself.
PASSWORD_IN_MAIL = r"\b(?:password|passcode|pwd|has[łl]o)(?:\s+(?:for|to|do)(?:\s+\w+){1,2})?\s*(?::|=|\bis\b|\bto\b)\s*\S+"

PASSWORD_WORDS = ["password", "passcode", "pwd", "hasł", "haslo"]

# --- look-alike characters -----------------------------------------------------------------------
# What is written -> what it is read as.
LOOKALIKES = {
    "rn": "m", "vv": "w", "cl": "d", "0": "o", "1": "l", "3": "e", "5": "s", "@": "a",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i",
    "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ο": "o", "α": "a",
}
# The same in the forms that replace() and translate() take: pairs of letters first, then single characters.
LOOKALIKE_PAIRS = [(fake, real) for fake, real in LOOKALIKES.items() if len(fake) > 1]
LOOKALIKE_CHARS = "".join(fake for fake in LOOKALIKES if len(fake) == 1)
LOOKALIKE_FOR = "".join(LOOKALIKES[fake] for fake in LOOKALIKE_CHARS)


def undisguised(label: str) -> str:
    """A label as it is read, for the few trusted names; columns use domains.undo_homoglyphs."""
    for fake, real in LOOKALIKES.items():
        label = label.replace(fake, real)
    return label


MIN_TYPO_LENGTH = 5
MIN_EMBEDDED_LENGTH = 6

# --- files ---------------------------------------------------------------------------------------
RISKY_EXTENSIONS = {
    "program": ["exe", "scr", "com", "pif", "msi", "cpl", "jar", "msc"],
    "script": ["js", "jse", "vbs", "vbe", "bat", "cmd", "ps1", "hta", "wsf", "wsh"],
    "disk_image": ["iso", "img", "vhd", "vhdx"],
    "shortcut": ["lnk"],
    "settings": ["reg"],
}
# What a kind of file is, and what opening it does.
RISKY_KINDS = {
    "program": ("a program", "Opening it would run it."),
    "script": ("a script, a small program", "Opening it would run it."),
    "disk_image": ("a disk image", "Opening it can unpack hidden programs."),
    "shortcut": ("a shortcut", "Opening it can run a hidden command."),
    "settings": ("a Windows settings file", "Opening it would change your computer's settings."),
}
DECOY_EXTENSIONS = {
    "a PDF": ["pdf"],
    "a Word document": ["doc", "docx", "odt", "rtf"],
    "a spreadsheet": ["xls", "xlsx", "ods", "csv"],
    "a presentation": ["ppt", "pptx", "odp"],
    "a text file": ["txt"],
    "a picture": ["jpg", "jpeg", "png", "gif", "bmp"],
    "a media file": ["mp3", "mp4", "wav", "avi", "mov"],
    "an archive": ["zip", "rar", "7z"],
}
MACRO_EXTENSIONS = [
    "docm", "dotm", "xlsm", "xltm", "xlam", "pptm", "potm", "ppsm",
    "doc", "dot", "xls", "xlt", "ppt", "pot", "pps",
]
HTML_EXTENSIONS = ["html", "htm", "shtml", "xhtml"]
HTML_TYPES = ["text/html", "application/xhtml+xml"]
ARCHIVE_EXTENSIONS = ["zip", "7z", "rar"]
ARCHIVE_TYPES = [
    "application/zip", "application/x-zip", "application/x-zip-compressed",
    "application/x-7z-compressed", "application/x-rar", "application/x-rar-compressed", "application/vnd.rar",
]
PROGRAM_TYPES = [
    "application/x-msdownload", "application/x-dosexec", "application/x-msdos-program",
    "application/x-executable", "application/vnd.microsoft.portable-executable",
    "application/x-msi", "application/x-ms-installer", "application/hta",
    "application/x-sh", "application/x-bat", "application/java-archive",
    "application/x-ms-shortcut", "application/javascript", "application/x-javascript",
    "text/javascript", "text/vbscript",
]
ATTACHMENT_SEVERITY = {
    "attachment.double_extension": 3, "attachment.risky_extension": 3, "attachment.type_mismatch": 3,
    "attachment.macro_office": 2, "attachment.html": 2, "attachment.encrypted_archive": 2,
}
# Control characters that mail clients hide: C0, DEL and C1, then the direction marks.
HIDDEN_CHAR_CLASS = "[\u0000-\u001f\u007f-\u009f\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]"

# --- risk ----------------------------------------------------------------------------------------
SEVERITY_NAMES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
SEVERITY_POINTS = {0: 0, 1: 1, 2: 3, 3: 6}
MEDIUM_AT, HIGH_AT = 3, 6
IMPERSONATION = ["brand_impersonation", "colleague_impersonation", "freemail_impersonation", "lookalike_domain"]
MAX_REASONS = 5
UNSURE_LOW, UNSURE_HIGH = 0.35, 0.65
ML_MODERATE, ML_STRONG = 0.60, 0.90

# --- campaigns -----------------------------------------------------------------------------------
WINDOW_SECONDS = 24 * 3600
JOIN_SCORE = 2
SIMILAR, NEAR_IDENTICAL = 0.5, 0.8
TRAIT_WORDING = 0.4
INVOICE_MIN_MESSAGES = 3
