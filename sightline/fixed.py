"""Fixed values.

Word lists, lookup tables, constants and patterns that must equal the published
behaviour for results to agree. They are data, stated as they are.
"""

from __future__ import annotations

# --- closed vocabularies -------------------------------------------------------
ENTITY_TYPES = [
    "domain", "subdomain", "ip", "cidr", "asn", "url", "email", "username", "account",
    "phone", "person", "org", "location", "geo", "file", "image", "hash", "cert", "cve",
    "wallet", "tx", "app", "repo", "package", "ioc", "text", "finding",
]
SEVERITIES = ["info", "low", "medium", "high", "critical"]
MODES = ["passive", "semi-active", "active"]

# --- scoring -------------------------------------------------------------------
RELIABILITY = {"A": 0.95, "B": 0.85, "C": 0.70, "D": 0.50, "E": 0.25, "F": 0.40}
CREDIBILITY = {"1": 1.00, "2": 0.85, "3": 0.65, "4": 0.40, "5": 0.15, "6": 0.50}
UNKNOWN_GRADE_WEIGHT = 0.40 * 0.50
HALF_LIFE_HOURS = 720
CONFLICT_PENALTY = 0.25
WEIGHT_CAP = 0.999
CONFIDENCE_CAP = 0.999
UNVERIFIED_CAP = 0.5
HEURISTIC_METHOD = 0.6
HEURISTIC_EDGE_CAP = 0.6
INDEPENDENCE_GROUPS = {
    "passive_dns": ["securitytrails", "virustotal", "circl", "dnsdb", "otx"],
    "ct_logs": ["crtsh", "certspotter", "censys-certs", "facebook-ct"],
    "scan_db": ["shodan", "censys", "zoomeye", "fofa", "binaryedge", "netlas"],
    "whois": ["whois-iana", "whois-arin", "whois-ripe", "whois-apnic", "whois-lacnic"],
    "geolocation": ["maxmind", "ipinfo", "ipapi", "dbip"],
    "blocklists": ["abuseipdb", "greynoise", "spamhaus", "pulsedive"],
}

# --- chains --------------------------------------------------------------------
GENESIS_HASH = "0" * 64

# --- URL canonicalisation ------------------------------------------------------
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "utm_name", "utm_reader", "utm_brand", "utm_social", "utm_social-type",
    "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "fbclid", "msclkid", "yclid", "twclid",
    "igshid", "mc_cid", "mc_eid", "_ga", "_gl", "ref", "referrer", "spm", "scm", "trk",
    "trkCampaign", "vero_id", "oly_enc_id", "oly_anon_id", "hsCtaTracking", "__hssc",
    "__hstc", "__hsfp",
]
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443"}

# --- registration text ---------------------------------------------------------
REGISTRATION_KEYS = {
    "registrar": [
        "registrar", "sponsoring registrar", "registrar name", "registrar organization",
        "registrar organisation", "registrar handle", "registrar company",
    ],
    "registrar_host": [
        "registrar whois server", "referralserver", "registrar url", "whois server", "referral url",
    ],
    "name_server": [
        "name server", "nameserver", "nserver", "name servers", "nameservers", "dns", "ns",
    ],
    "email": [
        "registrant email", "registrant contact email", "registrant contact", "admin email",
        "administrative contact email", "tech email", "technical contact email",
        "registrar abuse contact email", "abuse contact email", "abuse mailbox",
        "contact email", "email", "e mail",
    ],
    "status": ["domain status", "status", "state", "eppstatus"],
    "created": [
        "creation date", "created", "created on", "registered on", "registration time",
        "registered", "domain registration date", "record created", "activated",
    ],
    "expires": [
        "registry expiry date", "expiration date", "expires", "expires on", "expiry date",
        "paid till", "renewal date", "record expires",
        "registrar registration expiration date", "domain expiration date",
    ],
    "updated": [
        "updated date", "last updated", "last update", "modified", "changed",
        "last modified", "domain last updated date",
    ],
    "domain_name": ["domain name", "domain", "domainname", "query", "name"],
}
REDACTION_MARKERS = [
    "redacted for privacy", "data redacted", "not disclosed", "privacy protected",
    "privacy redacted", "redacted by gdpr", "gdpr masked", "withheld for privacy",
    "non-public data", "personal data", "redacted", "disclosed?",
]
MASK_MARKERS = [
    "privacy", "redacted", "notdisclosed", "not-disclosed", "disclosure", "withheld",
    "anonymized", "anonymised", "shielded", "obscured",
]
RATE_LIMIT_MARKERS = [
    "whois limit exceeded", "limit exceeded", "too many requests", "rate limit", "query rate",
    "queries per", "maximum number of queries", "you have exceeded", "exceeded the maximum",
    "try again later", "throttled",
]
EMPTY_ANSWER_MARKERS = [
    "no match for", "no entries found", "not found", "no data found", "domain not found",
    "no object found", "nothing found", "no such domain", "domain name not known",
]
TEXT_HOLD_STATUSES = [
    "clienthold", "serverhold", "pendingdelete", "redemptionperiod", "pendingrenew", "expired",
]
REGISTRY_HOLD_STATUSES = [
    "clienthold", "serverhold", "pendingdelete", "redemptionperiod", "pendingrestore",
    "addperiod", "autorenewperiod", "renewperiod", "transferperiod", "inactive",
]
CARD_PLACEHOLDERS = ["redacted for privacy", "data redacted", "not disclosed", "privacy redacted"]

# --- host indexes --------------------------------------------------------------
REFUSAL_MARKERS = [
    "api count exceeded", "exceeded the maximum", "error", "invalid", "rate limit",
    "too many requests", "quota", "upgrade", "unauthorized", "api key", "please contact",
    "try again later", "unavailable", "no results", "check your query", "invalid query",
]
INTERSTITIAL_MARKERS = [
    "captcha", "are you a human", "cloudflare", "checking your browser", "cf-browser-verification",
]
SHARED_SUFFIXES = {
    "amazonaws.com": "Amazon Web Services",
    "awsglobalaccelerator.com": "Amazon Web Services",
    "cloudfront.net": "Amazon CloudFront",
    "elb.amazonaws.com": "Amazon Elastic Load Balancing",
    "googleusercontent.com": "Google Cloud",
    "gcp": "Google Cloud",
    "googleapis.com": "Google Cloud",
    "appspot.com": "Google App Engine",
    "cloudapp.azure.com": "Microsoft Azure",
    "azurewebsites.net": "Microsoft Azure",
    "app-service.windows.net": "Microsoft Azure",
    "cloudapp.net": "Microsoft Azure",
    "digitaloceanspaces.com": "DigitalOcean",
    "linode.com": "Linode",
    "compute.amazonaws.com": "Amazon Web Services",
    "oraclecloud.com": "Oracle Cloud",
    "scaleway.com": "Scaleway",
    "hetzner.de": "Hetzner",
    "hetzner.com": "Hetzner",
    "ovh.net": "OVHcloud",
    "fastly.net": "Fastly",
    "akamaiedge.net": "Akamai",
    "akadns.net": "Akamai",
    "edgekey.net": "Akamai",
    "vercel.app": "Vercel",
    "netlify.app": "Netlify",
    "fly.dev": "Fly.io",
}
INTERNAL_HOSTS = ["localhost", "localhost.localdomain", "metadata.google.internal"]
INTERNAL_HOST_SUFFIXES = [".localhost", ".internal", ".local"]

# --- resolver record types -----------------------------------------------------
RR_TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA",
    33: "SRV", 43: "DS", 44: "SSHFP", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 50: "NSEC3",
    52: "TLSA", 64: "SVCB", 65: "HTTPS", 257: "CAA",
}

# --- address classes -----------------------------------------------------------
ADDRESS_CLASSES = [
    ("127.0.0.0/8", "loopback"),
    ("::1/128", "loopback"),
    ("224.0.0.0/4", "multicast"),
    ("ff00::/8", "multicast"),
    ("0.0.0.0/8", "this-network"),
    ("100.64.0.0/10", "shared-nat"),
    ("192.0.0.0/24", "protocol-assignment"),
    ("198.18.0.0/15", "benchmarking"),
    ("192.0.2.0/24", "documentation"),
    ("198.51.100.0/24", "documentation"),
    ("203.0.113.0/24", "documentation"),
    ("240.0.0.0/4", "reserved"),
    ("255.255.255.255/32", "broadcast"),
    ("169.254.169.254/32", "metadata"),
    ("169.254.0.0/16", "link-local"),
    ("fe80::/10", "link-local"),
    ("::/128", "unspecified"),
    ("64:ff9b::/96", "translation"),
    ("100::/64", "discard"),
    ("2001:db8::/32", "documentation"),
    ("fc00::/7", "private"),
    ("10.0.0.0/8", "private"),
    ("172.16.0.0/12", "private"),
    ("192.168.0.0/16", "private"),
]

# --- image metadata ------------------------------------------------------------
XMP_FIELDS = [
    "tiff:Make", "tiff:Model", "photoshop:DateCreated", "xmp:CreateDate", "xmp:ModifyDate",
    "xmp:CreatorTool", "dc:creator", "dc:rights", "exif:GPSLatitude",
]
AUTHOR_FIELDS = ["byline", "byline_title", "contact", "credit"]
DESCRIPTION_FIELDS = [
    "source", "credit_supplier", "caption_abstract", "copyright_notice", "caption",
]
EARTH_KM = 6371.0

# --- change severity -----------------------------------------------------------
MEDIUM_FACTS = ["resolves_to", "ip", "asn", "ns", "mx", "registrar", "tls_cert", "exposes"]
LOW_FACTS = ["exists", "attr", "http_status"]

# --- retention, hours and days -------------------------------------------------
RETENTION_DAYS = {"evidence": 365, "observations": 730, "audit": 2555, "high": 90}
