"""Lists, patterns and constants that results depend on."""

# Mail domains, mailbox names and corrections.
FREEMAIL = ["gmail.com", "googlemail.com", "yahoo.com", "yahoo.in", "yahoo.co.in", "yahoo.co.uk", "ymail.com", "rocketmail.com", "hotmail.com", "outlook.com", "live.com", "msn.com", "aol.com", "icloud.com", "me.com", "protonmail.com", "proton.me", "rediffmail.com", "zoho.com", "zohomail.in", "mail.com", "gmx.com", "yandex.com"]
ROLES = ["info", "contact", "admin", "support", "sales", "hello", "hi", "enquiry", "enquiries", "inquiry", "office", "care", "help", "team", "mail", "service", "services", "customercare", "marketing", "booking", "bookings", "reception", "query", "queries", "connect"]
DISPOSABLE = ["mailinator.com", "tempmail.com", "guerrillamail.com", "10minutemail.com", "yopmail.com", "trashmail.com", "sharklasers.com", "throwawaymail.com"]
TYPOS = {"gamil.com": "gmail.com", "gmial.com": "gmail.com", "gmai.com": "gmail.com", "gmail.om": "gmail.com", "gmail.co": "gmail.com", "gnail.com": "gmail.com", "gmail.cm": "gmail.com", "yahooo.com": "yahoo.com", "yaho.com": "yahoo.com", "hotmal.com": "hotmail.com", "outlok.com": "outlook.com", "rediffmail.co": "rediffmail.com"}
MAJORS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "rediffmail.com"]
LOOKALIKE_RATIO = 88
EMAIL_PATTERN = r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"

# Hosts nobody owns a business website on, by class, in the order they are tried.
HOST_CLASSES = {
    "social": ["facebook.com", "fb.com", "fb.me", "instagram.com", "instagr.am", "linkedin.com", "lnkd.in", "youtube.com", "youtu.be", "threads.com", "threads.net", "twitter.com", "x.com", "pinterest.com", "snapchat.com", "tiktok.com"],
    "messaging": ["wa.me", "whatsapp.com", "api.whatsapp.com", "t.me", "telegram.me", "m.me"],
    "aggregator": ["linktr.ee", "linktree.com", "beacons.ai", "bio.link", "taplink.cc", "carrd.co", "about.me"],
    "shortener": ["bit.ly", "tinyurl.com", "goo.gl", "rb.gy", "cutt.ly", "shorturl.at", "share.google", "g.co", "rebrand.ly"],
    "marketplace": ["amazon.in", "amazon.com", "flipkart.com", "play.google.com", "apps.apple.com", "justdial.com", "indiamart.com", "practo.com", "urbanpro.com", "sulekha.com"],
    "form": ["forms.gle", "docs.google.com", "calendly.com", "zcal.co", "typeform.com", "zoho.to"],
}
TRACKING_PATTERN = r"(?i)^(utm_|fbclid|gclid|mc_[ce]id|igshid|ref_?src)"
HANDLE_PATTERNS = {
    "facebook": [r"(?i)^/(?:pg/|pages/[^/]+/)?([^/?#]+)"],
    "instagram": [r"(?i)^/([^/?#]+)"],
    "youtube": [r"(?i)^/(?:channel|c|user)/([^/?#]+)", r"(?i)^/@([^/?#]+)"],
    "linkedin": [r"(?i)^/(?:company|in|school)/([^/?#]+)"],
}
#: Public suffixes of two labels; every other suffix is taken to have one. Callers may pass their own list.
SUFFIXES = ["ac.in", "ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.sg", "edu.in", "firm.in", "gen.in", "gov.in", "gov.uk", "net.au", "net.in", "nic.in", "org.au", "org.in", "org.uk"]
#: Telephone regions: calling code, leading digits that tell regions of one code apart, region, lengths of the national
#: number, patterns of its fixed and mobile ranges (equal ones are not told apart), trunk prefix, an example mobile number.
PHONE_RULES = [
    ("1", "", "US", "10", "[2-9][0-9]{2}[2-9][0-9]{6}", "[2-9][0-9]{2}[2-9][0-9]{6}", "1", "2015550123"),
    ("1", "204 226 236 249 250 263 289 306 343 354 365 367 368 382 387 403 416 418 428 431 437 438 450 468 474 506 514 519 548 579 581 584 587 604 613 639 647 672 683 705 709 742 753 778 780 782 807 819 825 867 873 879 902 905", "CA", "10", "[2-9][0-9]{2}[2-9][0-9]{6}", "[2-9][0-9]{2}[2-9][0-9]{6}", "1", "5062345678"),
    ("1", "658 876", "JM", "10", "(658|876)[2-9][0-9]{6}", "(658|876)[2-9][0-9]{6}", "1", "8762101234"),
    ("7", "", "RU", "10", "[348][0-9]{9}", "9[0-9]{9}", "8", "9123456789"),
    ("7", "6 7", "KZ", "10", "7[12][0-9]{8}", "7[04-7][0-9]{8}", "8", "7710009998"),
    ("20", "", "EG", "8 9 10", "([23][0-9]{7,8}|[4-9][0-9]{7,8})", "1[0-25][0-9]{8}", "0", "1001234567"),
    ("27", "", "ZA", "9", "[1-5][0-9]{8}", "[6-8][0-9]{8}", "0", "711234567"),
    ("30", "", "GR", "10", "2[0-9]{9}", "69[0-9]{8}", "", "6912345678"),
    ("31", "", "NL", "9", "[1-57][0-9]{8}", "6[1-58][0-9]{7}", "0", "612345678"),
    ("32", "", "BE", "8 9", "[1-9][0-9]{7}", "4[5-9][0-9]{7}", "0", "470123456"),
    ("33", "", "FR", "9", "[1-589][0-9]{8}", "[67][0-9]{8}", "0", "612345678"),
    ("34", "", "ES", "9", "[89][0-9]{8}", "[67][0-9]{8}", "", "612345678"),
    ("36", "", "HU", "8 9", "[1-9][0-9]{7}", "([237]0|31|50)[0-9]{7}", "06", "201234567"),
    ("39", "", "IT", "6 7 8 9 10 11", "0[0-9]{5,10}", "3[0-9]{8,9}", "", "3123456789"),
    ("40", "", "RO", "9", "[23][0-9]{8}", "7[0-9]{8}", "0", "712034567"),
    ("41", "", "CH", "9", "[2-68][0-9]{8}", "7[5-9][0-9]{7}", "0", "781234567"),
    ("43", "", "AT", "7 8 9 10 11 12 13", "[1-57][0-9]{6,12}", "6[5-9][0-9]{7,11}", "0", "664123456"),
    ("44", "", "GB", "9 10", "[1238][0-9]{8,9}", "7[1-57-9][0-9]{8}", "0", "7400123456"),
    ("45", "", "DK", "8", "[2-9][0-9]{7}", "[2-9][0-9]{7}", "", "34412345"),
    ("46", "", "SE", "7 8 9 10", "[1-689][0-9]{6,9}", "7[02369][0-9]{7}", "0", "701234567"),
    ("47", "", "NO", "8", "[235-7][0-9]{7}", "[49][0-9]{7}", "", "40612345"),
    ("48", "", "PL", "9", "(1[2-8]|2[2-69]|3[2-4]|4[1-468]|5[24-689]|6[1-3578]|7[14-7]|8[1-7]|9[145])[0-9]{7}", "(45|5[0137]|6[069]|7[2389]|88)[0-9]{7}", "", "512345678"),
    ("49", "", "DE", "6 7 8 9 10 11", "[2-9][0-9]{5,10}", "1[5-7][0-9]{8,9}", "0", "15123456789"),
    ("51", "", "PE", "8 9", "[1-8][0-9]{7}", "9[0-9]{8}", "0", "912345678"),
    ("52", "", "MX", "10", "[2-9][0-9]{9}", "[2-9][0-9]{9}", "", "2221234567"),
    ("54", "", "AR", "10 11", "[1-3][0-9]{9}", "9[1-3][0-9]{9}", "0", "91123456789"),
    ("55", "", "BR", "10 11", "[1-9][1-9][2-5][0-9]{7}", "[1-9][1-9]9[0-9]{8}", "0", "11961234567"),
    ("56", "", "CL", "9", "[2-9][0-9]{8}", "[2-9][0-9]{8}", "", "221234567"),
    ("57", "", "CO", "10", "60[1-8][0-9]{7}", "3[0-5][0-9]{8}", "0", "3211234567"),
    ("60", "", "MY", "8 9 10", "[3-9][0-9]{7,8}", "1[0-9]{8,9}", "0", "123456789"),
    ("61", "", "AU", "9", "[2378][0-9]{8}", "4[0-9]{8}", "0", "412345678"),
    ("62", "", "ID", "8 9 10 11 12", "[2-79][0-9]{7,10}", "8[1-9][0-9]{7,10}", "0", "812345678"),
    ("63", "", "PH", "8 9 10", "[2-8][0-9]{7,8}", "9[0-9]{9}", "0", "9051234567"),
    ("64", "", "NZ", "8 9 10", "[34679][0-9]{7}", "2[0-9]{7,9}", "0", "211234567"),
    ("65", "", "SG", "8", "[36][0-9]{7}", "[89][0-9]{7}", "", "81234567"),
    ("66", "", "TH", "8 9", "[2-7][0-9]{7}", "[689][0-9]{8}", "0", "812345678"),
    ("81", "", "JP", "9 10", "[1-9][0-9]{8}", "[7-9]0[0-9]{8}", "0", "9012345678"),
    ("82", "", "KR", "8 9 10", "([2-6][0-9]{7,9}|70[0-9]{8})", "1[0-26-9][0-9]{7,8}", "0", "1020000000"),
    ("84", "", "VN", "9 10", "2[0-9]{9}", "[35789][0-9]{8}", "0", "912345678"),
    ("86", "", "CN", "9 10 11", "[2-9][0-9]{8,10}|10[0-9]{8}", "1[3-9][0-9]{9}", "0", "13123456789"),
    ("90", "", "TR", "10", "[2-4][0-9]{9}", "5[0-9]{9}", "0", "5012345678"),
    ("91", "", "IN", "10", "[2-5][0-9]{9}", "[6-9][0-9]{9}", "0", "8123456789"),
    ("92", "", "PK", "9 10", "[24-9][0-9]{8,9}", "3[0-9]{9}", "0", "3012345678"),
    ("94", "", "LK", "9", "[1-689][0-9]{8}", "7[0-9]{8}", "0", "712345678"),
    ("234", "", "NG", "8 10", "[1-9][0-9]{7}", "[789][01][0-9]{8}", "0", "8021234567"),
    ("233", "", "GH", "9", "3[0-9]{8}", "[25][0-9]{8}", "0", "231234567"),
    ("254", "", "KE", "9", "[24-6][0-9]{8}", "[17][0-9]{8}", "0", "712123456"),
    ("351", "", "PT", "9", "2[0-9]{8}", "9[1-36][0-9]{7}", "", "912345678"),
    ("353", "", "IE", "7 8 9 10", "[124-79][0-9]{6,9}", "8[3-9][0-9]{7}", "0", "850123456"),
    ("358", "", "FI", "5 6 7 8 9 10", "[1-356-9][0-9]{4,9}", "(4[0-9]{5,9}|50[0-9]{4,8})", "0", "412345678"),
    ("380", "", "UA", "9", "[345][0-9]{8}", "(50|6[36-8]|73|9[1-9]|39)[0-9]{7}", "0", "501234567"),
    ("420", "", "CZ", "9", "[2-5][0-9]{8}", "[67][0-9]{8}", "", "601123456"),
    ("852", "", "HK", "8", "[23][0-9]{7}", "[4-79][0-9]{7}", "", "51234567"),
    ("880", "", "BD", "8 9 10", "[2-9][0-9]{7,9}", "1[3-9][0-9]{8}", "0", "1812345678"),
    ("886", "", "TW", "8 9", "[2-8][0-9]{7,8}", "9[0-9]{8}", "0", "912345678"),
    ("966", "", "SA", "9", "1[0-9]{8}", "5[0-9]{8}", "0", "512345678"),
    ("971", "", "AE", "8 9", "[2-4679][0-9]{7}", "5[024-68][0-9]{7}", "0", "501234567"),
    ("972", "", "IL", "8 9", "[23489][0-9]{7}", "5[0-9]{8}", "0", "502345678"),
    ("977", "", "NP", "8 10", "[1-8][0-9]{7}", "9[678][0-9]{8}", "0", "9841234567"),
]
#: Lengths that a number of a region without rules may have.
PHONE_LENGTHS = (7, 15)

#: Public suffix rules in the published notation: plain, wildcard and exception ones. Callers may pass a whole list (``suffixes.read_rules``).
SUFFIX_RULES = [
    "com", "org", "net", "edu", "gov", "info", "biz", "io", "dev", "app", "test", "in", "ac.in", "co.in", "edu.in", "firm.in", "gen.in", "gov.in", "net.in", "nic.in", "org.in",
    "uk", "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "*.sch.uk", "au", "com.au", "net.au", "org.au", "nz", "co.nz", "org.nz", "za", "co.za", "br", "com.br", "sg", "com.sg", "*.bd", "*.ck", "!www.ck", "*.er", "*.fk", "*.kh", "*.mm", "*.np",
    "jp", "ac.jp", "co.jp", "go.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.kitakyushu.jp", "!city.kitakyushu.jp", "*.kobe.jp", "!city.kobe.jp", "*.nagoya.jp", "!city.nagoya.jp", "*.sapporo.jp", "!city.sapporo.jp", "*.sendai.jp", "!city.sendai.jp", "*.yokohama.jp", "!city.yokohama.jp",
]

# Names.
PLACEHOLDER_PATTERN = r"(?i)^\s*advertiser\s*\d+\s*$"
LEGAL_SUFFIXES = ["private limited", "pvt ltd", "pvt. ltd.", "pvt limited", "p ltd", "limited", "ltd", "llp", "inc", "incorporated", "corporation", "corp", "co", "company"]
BUSINESS_TOKENS = ["academy", "associates", "ayurveda", "care", "center", "centre", "clinic", "college", "consultancy", "consultants", "consulting", "corp", "diagnostics", "enterprises", "foundation", "group", "gym", "healthcare", "hospital", "institute", "insurance", "international", "labs", "limited", "llp", "ltd", "pvt", "school", "services", "solutions", "studio", "technologies", "technovation", "trust", "university", "ventures", "wellness"]
HONORIFICS = ["dr", "dr.", "mr", "mrs", "ms", "prof", "acharya", "pandit", "guru", "vaidya", "ca"]
NAME_LENGTH = 512

# Places and categories.
PLACE_CONFIDENCE = {"exact": 1.0, "alias": 0.9, "locality": 0.75, "state": 0.5}
UNCLASSIFIED = "unclassified"

# Quality rubric: weights, penalties by issue code, limits.
RUBRIC_VERSION = "1.1"
WEIGHTS = {"identity_present": 8, "contact_reachable": 14, "mailbox_verified": 10, "owned_website": 14, "website_live": 10, "channel_breadth": 10, "audience_evidence": 8, "location_resolved": 10, "category_known": 8, "identity_verifiable": 6, "provenance_observed": 2}
PENALTIES = {"mailbox_domain_dead": 15, "website_dead": 8, "duplicate_email_domain_mismatch": 4, "thin_record": 12, "placeholder_name": 10, "zero_followers": 5, "email_typo_corrected": 3, "city_unusable": 3}
PENALTY_OF_CODE = {"email_domain_website_mismatch": "duplicate_email_domain_mismatch", "thin_record": "thin_record", "name_placeholder": "placeholder_name", "zero_followers": "zero_followers", "email_typo_domain_corrected": "email_typo_corrected", "city_address_fragment": "city_unusable", "city_not_a_place": "city_unusable"}
MOST_PENALTY, FOLLOWERS_REFERENCE, THIN_FOLLOWERS, FOLLOWERS_CEILING = 30, 100_000, 100, 500_000_000
CHANNEL_KINDS = ["website", "linkedin", "instagram", "youtube"]
MANAGED_PROVIDERS = ["google", "microsoft", "zoho", "godaddy", "hostinger", "mimecast", "proofpoint"]

# Verification.
MX_SUFFIXES = [("mail.protection.outlook.com", "microsoft"), ("outlook.com", "microsoft"), ("hotmail.com", "microsoft"), ("google.com", "google"), ("googlemail.com", "google"), ("zoho.com", "zoho"), ("zoho.in", "zoho"), ("zohomail.com", "zoho"), ("yandex.net", "yandex"), ("pphosted.com", "proofpoint"), ("mimecast.com", "mimecast"), ("secureserver.net", "godaddy"), ("hostinger.com", "hostinger"), ("hostinger.in", "hostinger"), ("rediffmail.com", "rediff"), ("rediffmailpro.com", "rediff")]
PARKED_MARKERS = ["this domain is for sale", "buy this domain", "domain is parked", "parked domain", "domain for sale", "future home of something quite cool", "godaddy.com/domainsearch", "sedoparking", "hugedomains", "afternic", "bodis.com", "under construction", "coming soon", "default web site page", "welcome to nginx", "apache2 ubuntu default page", "index of /"]
#: Hours a result stays fresh, by status.
TTL_HOURS = {"verified": 720, "unreachable": 168, "unknown": 6, "skipped": 720}
WEB_PORTS = [80, 443, 8080, 8443]
#: IPv4 networks that cannot be reached from the internet: special purpose, multicast and reserved.
CLOSED_NETWORKS = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]

# Duplicate pairs.
HOST_GROUP, BLOCK_GROUP, NAME_RATIO = 12, 12, 92
QUALITY_BANDS = [("0-19", 0.0, 20.0), ("20-39", 20.0, 40.0), ("40-59", 40.0, 60.0), ("60-79", 60.0, 80.0), ("80-100", 80.0, 100.01)]
