"""Sentences shown to people.

Fixed values: the texts are part of the result, so they are stated as they must read; `{name}` marks
where a value goes.
"""

NO_AUTH_RESULTS = ("We could not check whether the sender's domain approved this email, "
                   "because it carries no authentication results.")
NO_DMARC_POLICY = ("We could not confirm this email really comes from {domain}, "
                   "because that domain publishes no DMARC policy.")
NO_SENDER = "We could not check who sent this email, because it has no sender address."
SENDERS_DOMAIN = "the sender's domain"

AUTH = [  # (mechanism, result, severity, sentence), strongest first
    ("dmarc", "fail", 2, "The domain {domain} could not confirm that it sent this email, so the sender address may be forged."),
    ("spf", "fail", 2, "The server that delivered this email is not allowed to send mail for {domain}, so the sender may be forged."),
    ("spf", "softfail", 1, "The server that delivered this email is probably not allowed to send mail for {domain}."),
    ("dkim", "fail", 1, "The digital seal on this email is broken, so it may have been changed on the way or not sent by {domain}."),
]
REPLY_TO = "If you reply, your answer goes to {reply_to}, not to {domain}, where the email claims to come from."
RETURN_PATH = ("Error reports for this email go to {return_domain} rather than {domain}, "
               "which newsletter services also do, so alone it means little.")

BRAND_NAME_FREEMAIL = "The sender calls itself '{name}', but writes from a personal {domain} address, not an official {brand} one."
BRAND_NAME = "The sender calls itself '{name}', but the email comes from {domain}, which is not a {brand} address."
BRAND_SIGNATURE = "The email is signed as {brand}, but its links lead to {where}, not to a {brand} website."
BRAND_SUBJECT = "The subject mentions {brand}, but the email's links lead to {where}, not to a {brand} website."
FREEMAIL_NAME = "The sender calls themselves '{name}' but writes from a personal {domain} address, not a company one."
FREEMAIL_SIGNED = "The email is signed '{name}' but comes from a personal {domain} address, not a company one."
COLLEAGUE_FREEMAIL = "The sender uses the name of your colleague {name} ({title}) but writes from a personal {domain} address."
COLLEAGUE = "The sender uses the name of your colleague {name} ({title}) but writes from {domain}, outside the company."

LOOKALIKE_SENDER_TRICK = "The sender's domain {host} imitates {who}: {trick}."
LOOKALIKE_SENDER_COMPANY = "The sender's domain {host} uses our company's name, but it is not our company's domain."
LOOKALIKE_SENDER_BRAND = "The sender's domain {host} uses the name {brand}, but it is not a {brand} address."
LOOKALIKE_LINK_TRICK = "The link leads to {host}, an imitation of {who}: {trick}."
LOOKALIKE_LINK_COMPANY = "The link leads to {host}, which uses our company's name but is not our company's website."
LOOKALIKE_LINK_BRAND = "The link leads to {host}, which uses the name {brand} but is not a {brand} website."
OUR_COMPANY = "our company's domain"

TEXT_MISMATCH = "The link shows {shown} but actually leads to {host}."
AT_SIGN_HOST = "The link looks like it goes to {fake} but really goes to {host}."
AT_SIGN_TEXT = "The link hides extra text in front of the real address, which is {host}."
IP_HOST = "The link goes to a bare number address ({ip}) instead of a named website."
BRAND_SUBDOMAIN = "The address starts with '{brand_domain}', but the real website is {real}."
PUNYCODE = ("The web address {host} uses letters from another alphabet that look like normal ones, "
            "so it may not be the site it seems to be.")
DEEP_SUBDOMAIN = "The web address {host} is unusually long and nested, which can hide the real site, {real}."
SHORTENER = "The link uses a shortening service ({host}), which hides where it really goes."
LOGIN_PATH = "The link leads to a sign-in or verification page on {host}."
FOREIGN_DOMAIN = "The link leads to {shown}, which is not the sender's own website ({sender})."

CONTENT = {
    "urgency": 'The email pushes you to act fast: "{quote}"',
    "credential_request": 'The email asks you to sign in or confirm your account details: "{quote}"',
    "payment_change": 'The email says the bank account for a payment has changed: "{quote}"',
    "gift_card": 'The email asks for gift cards, which scammers like because they cannot be traced: "{quote}"',
    "mfa_code_request": 'The email asks you to share a sign-in code or approve sign-in prompts: "{quote}"',
}

NO_FILE_NAME = "An attachment without a name"
FILE_REVERSED = ("The file shows as '{shown}', but a hidden character reverses its name: "
                 "it is actually {kind}. {consequence}")
FILE_DECOY = "{label} pretends to be {decoy} but is actually {kind}. {consequence}"
FILE_COM = "{label} looks like a web address but is a program file. Opening it would run it."
FILE_RISKY = "{label} is {kind}. {consequence}"
FILE_TYPE_UNNAMED = "An attachment without a name is marked as a program. Opening it could run it."
FILE_TYPE_DECOY = "{label} looks like {decoy}, but the email marks it as a program. Opening it could run it."
FILE_TYPE_OTHER = "{label} does not look like a program, but the email marks it as one. Opening it could run it."
FILE_MACRO = ("{label} is an Office file that can contain macros: small programs that run "
              "if you click 'Enable content'.")
FILE_HTML = "{label} opens a web page from your computer, a common way to show a fake login or payment form."
FILE_ENCRYPTED = ("{label} is {article} password-protected archive, a common way to hide malware "
                  "from security scanners.")
FILE_PASSWORD = ("{label} is an archive and the email gives its password, a common way to hide "
                 "malware from security scanners.")
FILE_MORE_ONE = " The email has 1 more file like it."
FILE_MORE_MANY = " The email has {more} more files like it."

INTEL_FROM = "The sender {address} is on our list of known phishing senders."
INTEL_REPLY = "Replies would go to {address}, which is on our list of known phishing senders."
INTEL_FROM_DOMAIN = "The email comes from {listed}, which is on our list of known phishing domains."
INTEL_REPLY_DOMAIN = "Replies would go to {listed}, which is on our list of known phishing domains."
INTEL_URL = "The link to {host} leads to a page on our list of known phishing sites."
INTEL_HOST = "The link leads to {listed}, which is on our list of known phishing sites."
INTEL_SERVER = "This email was sent from a server ({ip}) that is on our list of known phishing sources."
INTEL_LINK_SERVER = "The link leads to a server ({ip}) that is on our list of known phishing sources."

ML_STRONG = "The wording of this email closely matches known phishing emails."
ML_WEAK = "Parts of the wording resemble phishing emails."
ML_MISSING = "We could not run the text classifier, so the wording was not analysed."
ML_UNSURE = ("Our text classifier is unsure about the wording of this email; "
             "this does not prove it is safe or malicious.")

FLOOR_RULES = {
    "credential": "floor: credential request from an impersonated sender",
    "known_bad": "floor: known malicious indicator",
    "mfa": "floor: request for an MFA code or approval",
    "gift_card": "floor: gift card request from an impersonated colleague",
    "payment": "floor: payment change with a mismatched or impersonated sender",
}
CAP_RULE = "cap: no moderate rule-based signal, ML and weak signals alone stay at MEDIUM"

SUMMARY = [
    "We found no warning signs in this email.",
    "This email has some warning signs. It may be legitimate, but be careful.",
    "This email is very likely a phishing attempt.",
    "This email is part of an active attack that may already have compromised an account.",
]
BASE_ACTION = [
    "No action is needed. If something still feels off, report the message.",
    "Before clicking links or replying, confirm the request through another channel you trust.",
    "Do not click any links, open attachments or reply. Report the message.",
    "Do not interact with this email. Report it now and follow your administrator's instructions.",
]
SPECIFIC_ACTION = [
    ("credential_request", "Do not enter your password. If you need the service, open it directly, not through the link."),
    ("mfa_code_request", "Never approve unexpected sign-in prompts or share verification codes."),
    ("payment_change", "Do not change any payment details. Confirm by phone using a number you already know."),
    ("gift_card", "Do not buy gift cards. Check with the person directly, not by replying."),
    ("risky_attachment", "Do not open the attachment."),
]

# How a look-alike name was made.
SUBSTITUTION = {
    "pair": "the letters '{fake}' stand in for the letter '{real}'",
    "digit": "the letter '{real}' was replaced by the digit '{fake}'",
    "sign": "the letter '{real}' was replaced by '{fake}'",
    "letter": "the letter '{real}' was replaced by a look-alike letter from another alphabet",
}
EDIT = {
    "swapped": "the letters '{a}{b}' were swapped",
    "replaced": "the letter '{a}' was replaced by {by}",
    "added": "an extra '{a}' was added to '{name}'",
    "left_out": "the letter '{a}' was left out of '{name}'",
}
EDIT_DIGIT = "the digit '"

# What the mails of a campaign share.
CAMPAIGN_NAME = "Suspicious emails from "
TRAITS = {
    "link_host": "Same link target in all {n} messages: {host}",
    "most_hosts": "Link target {host} in {c} of {n} messages",
    "link": "Same link in all {n} messages: {url}",
    "sender": "Same sender address in all {n} messages: {sender}",
    "sender_domain": "Same sender domain in all {n} messages: {domain} ({a} different addresses)",
    "wording": "Similar wording (about {p}% shared phrasing)",
    "span": "All delivered within ",
}
