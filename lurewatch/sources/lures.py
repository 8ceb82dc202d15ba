"""Mail wrappers put around the given documents.

The documents are invented prose without a sender, links or files. Each document gets one of these
wrappers by its id, so that every rule meets mails that break it and mails that do not.
`{g}` is a group number of about four mails of one kind, `{p}` a group whose mails lie far apart in
time, `{e}` an employee's name and `{r}` the same name as "Last, First".
"""

from __future__ import annotations

COLUMNS = [
    "kind", "subject", "sentence", "signature", "sender_name", "sender", "reply_to", "return_path", "auth",
    "hop_ip", "url", "anchor", "text_url", "filename", "content_type", "encrypted",
]
_PASS = "mx.corvane-freight.example; spf=pass; dkim=pass; dmarc=pass"


def _lure(kind: int, subject: str, sentence: str, sender_name: str, sender: str, *, signature: str = "Kind regards",
          reply_to: str | None = None, return_path: str | None = None, auth: str | None = _PASS,
          hop_ip: str = "198.51.100.7", url: str | None = None, anchor: str | None = None,
          text_url: str | None = None, filename: str | None = None, content_type: str = "application/pdf",
          encrypted: bool = False) -> tuple:
    return (kind, subject, sentence, signature, sender_name, sender, reply_to, return_path, auth, hop_ip, url, anchor,
            text_url, filename, content_type if filename else None, encrypted)


LURES = [
    _lure(0, "Team lunch on Friday", "We meet at noon by the door.", "Mira Vale12", "user12@corvane-freight.example"),
    _lure(1, "Security alert", "Unusual sign-in activity was found, verify your account within 24 hours or it will be suspended.",
          "Microsoft Account Team", "no-reply@micr0soft-alerts{g}.test", signature="The account team",
          auth="mx.corvane-freight.example (mx (inner; dmarc=pass (a (b (c))))); spf=softfail; dkim=none; dmarc=fail",
          url="https://login.micr0soft-alerts{g}.test/verify?u=1", anchor="https://account.microsoft.com/security"),
    _lure(2, "Quick favour", "Please buy gift cards for a client, scratch the back and send me the photos right away.",
          "{e}", "ceo.office{g}@gmail.com", signature="Managing Director"),
    _lure(3, "Invoice 20431", "Please note our bank details have changed, pay the open invoice to the new account and use IBAN GB33BUKB20201555555555.",
          "Inkwell Supplies", "accounts@inkwe1l-{g}.test", reply_to="billing@harbor-pay{g}.test",
          return_path="<bounce@mailer{g}.test>", filename="invoice.pdf"),
    _lure(4, "Your phone", "Read me the code you get, the one-time password expires in 10 minutes, and approve all prompts.",
          "IT Helpdesk", "it.desk{g}@outlook.com", signature="IT Helpdesk"),
    _lure(5, "Open question", "We still wait for your answer.", "Nora Finch", "nora.finch{g}@freemail.test",
          signature="Nora Finch\nAccounts Payable\nSent from my phone", url="http://bit.ly/{g}x", anchor="the list"),
    _lure(6, "Document waiting", "Your document is waiting for a signature.", "Esign", "post@mail.esign-vault.test",
          hop_ip="203.0.113.51", url="https://docs.esign-vault.test/sign/{g}", anchor="Open the document"),
    _lure(7, "Parcel on hold", "The parcel could not be delivered.", "Parcel desk", "alerts@delivery-{g}.test",
          url="http://203.0.113.51/secure/login", anchor="Track", text_url="http://3221225994/a",
          filename="label.html", content_type="text/html"),
    _lure(8, "A file was shared", "A file was shared with you, log in to confirm.", "File service", "info@review-{g}.test",
          url="https://microsoft.com.session.review-{g}.test/account", anchor="Open file",
          text_url="https://dhl.com@track-{g}.test/go"),
    _lure(9, "Shared folder", "A folder was shared with you.", "{r}", "share{g}@folder-host.test",
          url="https://xn--mcrosoft-thh.test/{g}", anchor="folder-host.test/{g}"),
    _lure(10, "Statement", "The statement of last month is attached.", "Statements", "docs@statement-{g}.test",
          filename="statement.pdf.exe", content_type="application/x-msdownload"),
    _lure(11, "Overview", "See the attached overview.", "Overview desk", "desk@overview-{g}.test",
          filename="invoice\u202efdp.exe", content_type="application/octet-stream"),
    _lure(12, "Budget", "The budget sheet is attached.", "Budget partner", "anna@partner-{p}.example",
          url="https://partner-{p}.example/x", anchor="our page", filename="budget.xlsm",
          content_type="application/vnd.ms-excel.sheet.macroenabled.12"),
    _lure(13, "Scan", "The scan is attached.", "Scanner", "scan@scans-{g}.test", filename="scan.zip",
          content_type="application/zip", encrypted=True),
    _lure(14, "Papers", "The password for the file: delta77 opens it.", "Papers desk", "papers@papers-{g}.test",
          filename="docs.7z", content_type="application/x-7z-compressed"),
    _lure(15, "Photo", "The photo you asked for.", "Photo desk", "photo@photos-{p}.test", filename="photo.jpg",
          content_type="application/x-dosexec", auth="mx.corvane-freight.example; spf=hardfail; dkim=fail; dkim=pass"),
    _lure(16, "Web page", "Our new web page is ready.", "Web desk", "web@pages-{g}.test", filename="www.corvane.com",
          content_type="application/octet-stream"),
    _lure(17, "Your delivery window", "Choose a delivery window that suits you.", "Delivery news",
          "news@swiftbox-updates{g}.test", url="https://www.swiftbax.example/choose", anchor="swiftbox.example"),
    _lure(18, "Your Microsoft invoice", "Action required: update your password today.", "Billing Desk",
          "billing@softsales-{p}.test", signature="Kind regards\nMicrosoft Billing", text_url="https://pay.softsales-{p}.test/confirm",
          auth="mx.corvane-freight.example; spf=none; dmarc=none"),
    _lure(19, "Late payment", "The payment is late.", "Billing", "billing.desk@freemail.test",
          reply_to="x@spam-farm.example.org", return_path="x@freemail.test", url="http://files.quickdrop.test/get/7/", anchor="bill"),
    _lure(20, "Reading list", "Here is the reading list.", "Reader", "reader@news-{g}.example",
          url="https://a.b.c.news-{g}.example/read", anchor="read", auth="mx.corvane-freight.example; spf=softfail"),
    _lure(21, "Newsletter", "This is not urgent and there is no action required.", "Press", "press@press-{g}.example",
          url="https://press-{g}.example/today", anchor="press-{g}.example"),
    _lure(22, "Agenda", "The agenda is below.", "Partner", "agenda@partner-{g}.example",
          auth="mx.corvane-freight.example (((((((((((( ; dkim=pass )))))))))))); dkim=fail"),
    _lure(23, "Note", "A short note for the record.", "", "", auth=None),
]
KINDS = len(LURES)
FIRST_NAMES = ["Mira", "Nadia", "Oskar", "Pavel", "Rita", "Sven", "Tara", "Uma", "Viktor", "Wanda"]
DEPARTMENTS = ["Finance", "Human Resources", "IT", "Logistics", "Sales", "Management"]
