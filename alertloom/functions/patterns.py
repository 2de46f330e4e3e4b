"""Patterns and word lists whose results must stay as they are. Matching is Unicode-aware and ignores case."""

# --- indicators ------------------------------------------------------------------------------------------------
URL = r"\bhttps?://[^\s<>'\"`)\]]+"
URL_TRAIL = r"[.,;:!?)\"\]'}>]+$"
IPV4 = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])"
DOMAIN = r"(?<![@\w.-])(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+(?:[A-Za-z]{2,63}|xn--[A-Za-z0-9-]{2,59})(?![\w.-])"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}\b"
HASH = r"\b(?:[A-Fa-f0-9]{32}|[A-Fa-f0-9]{40}|[A-Fa-f0-9]{64})\b"
CVE = r"\bCVE-\d{4}-\d{4,7}\b"
TECHNIQUE = r"\bT\d{4}(?:\.\d{3})?\b"
ACTOR = r"\b(?:APT\d{1,3}|G\d{4}|TA\d{4}|FIN\d{1,3})\b"
#: Change no match: cheap tests of the first characters, before those of Unicode word edges.
AHEAD = {URL: "(?=h)", IPV4: r"(?=\d)", DOMAIN: r"(?<![@A-Za-z0-9._-])(?=[A-Za-z0-9-]{1,63}\.)", EMAIL: "(?=[A-Za-z0-9._%+-])", HASH: "(?=[A-Fa-f0-9]{32})", CVE: "(?=c)", TECHNIQUE: "(?=t)", ACTOR: "(?=[agtf])"}
#: Text without these characters holds no match.
NEEDED = {URL: "://", EMAIL: "@", CVE: "-"}
FILE_SUFFIXES = (".exe", ".dll", ".sys", ".json", ".yaml", ".yml", ".conf", ".local", ".log", ".txt", ".pdf", ".png", ".jpg", ".jpeg", ".gif", ".md")

# --- passage labels --------------------------------------------------------------------------------------------
LABELS = {
    "ioc_listing": r"\b(?:ioc|indicator|indicators|hashes?|sha256|sha1|md5|c2 server|command and control|malicious ip|malicious domain|callback domain)\b",
    "ttp_behavior": r"\b(?:tactic|technique|procedure|ttp|mitre|attack|lateral movement|persistence|privilege escalation|credential access|defense evasion|execution|exfiltration|discovery|command[- ]and[- ]control)\b",
    "attribution": r"\b(?:attributed to|associated with|threat actor|apt\d{1,3}|fin\d{1,3}|ta\d{4}|g\d{4}|campaign|cluster|malware family|operator|nation[- ]state)\b",
    "remediation": r"\b(?:mitigation|remediation|recommendation|block|isolate|patch|disable|harden|detect|monitor|hunt|contain|eradicate|recover)\b",
    "victim_infrastructure": r"\b(?:victim|target(?:ed)?|compromised host|internal network|enterprise|organization|customer|affected system|infected machine)\b",
    "analysis_environment": r"\b(?:sandbox|lab|test environment|analysis machine|virtual machine|localhost|loopback|sample execution|detonation|pcap|researcher)\b",
    "vulnerability": r"\b(?:cve-\d{4}-\d{4,7}|vulnerab|exploit|rce|remote code execution|sql injection|xss|buffer overflow|zero[- ]day)\b",
}

# --- roles of an indicator near its mention, in priority order ---------------------------------------------------
DISPOSITIONS = {
    "benign": r"\b(?:benign|legitimate|clean|allowlist|allowlisted|known good|false positive|not malicious|not associated with|not related to|unrelated|security vendor|sinkhole|sinkholed|researcher domain|trusted|normal traffic|expected traffic)\b",
    "malicious": r"\b(?:malicious|ioc|indicator|c2|command and control|callback|beacon|exfiltrat|payload|dropper|phishing|ransomware|trojan|backdoor|botnet|attacker|adversary|threat actor|used by|associated with)\b",
    "victim": r"\b(?:victim|target(?:ed)?|compromised host|affected system|infected machine|internal host|internal network|enterprise|organization|customer)\b",
    "analysis_environment": r"\b(?:sandbox|lab|test environment|analysis machine|virtual machine|detonation|pcap|researcher|localhost|loopback|example)\b",
    "remediation_reference": r"\b(?:block|allowlist|denylist|firewall|sinkhole|monitor for|hunt for|detect|mitigation|remediation|recommendation)\b",
}

# --- behaviour tags of a passage -------------------------------------------------------------------------------
BEHAVIORS = {
    "reconnaissance_or_scanning": r"\b(?:scan|scanning|reconnaissance|recon|probe|enumerat|sweep|nmap|masscan|port scan|discovery)\b",
    "credential_attack": r"\b(?:credential|password|brute force|spray|phish|login attempt|valid account|dump(?:ed|ing)? credentials?|lsass|mimikatz)\b",
    "phishing_or_email_delivery": r"\b(?:phish|spearphish|spear[- ]phishing|email|smtp|attachment|malspam|macro document|weaponized document|document review)\b",
    "possible_c2": r"\b(?:c2|c&c|command and control|callback|beacon|implant|backdoor|rat\b|remote access trojan|check[- ]in)\b",
    "possible_exfiltration": r"\b(?:exfiltrat|data theft|stolen data|upload(?:ed|ing)?|archive(?:d|s)? and upload|ftp|cloud storage|dropbox|mega)\b",
    "malware_or_destructive_activity": r"\b(?:malware|ransomware|wiper|destructive|encrypt(?:ed|ion)?|payload|dropper|trojan|worm|file write|delete shadow copies)\b",
    "lateral_movement_candidate": r"\b(?:lateral movement|remote services?|smb|windows admin shares?|psexec|wmic|rdp|ssh|winrm|admin share|network share)\b",
    "web_or_exploit_attempt": r"\b(?:exploit|rce|remote code execution|web shell|sql injection|xss|deserialization|path traversal|cve-\d{4}-\d{4,7})\b",
    "malware_execution_candidate": r"\b(?:powershell|cmd\.exe|wscript|cscript|rundll32|regsvr32|mshta|scheduled task|process injection|execute|execution)\b",
    "domain_or_tls_indicator": r"\b(?:domain|dns|tls|ssl|certificate|sni|http host|hostname|url)\b",
}

# --- behaviour tags of an alert, in order: pattern on its lower-case text, destination ports --------------------
ALERT_TAGS = {
    "reconnaissance_or_scanning": (r"\b(?:scan|scanner|nmap|masscan|recon|probe|enumerat|portscan|port scan)\b", ()),
    "credential_attack": (r"\b(?:brute force|bruteforce|authentication failure|failed login|password guess|ssh login|phish|smtp|email attachment|mail_from)\b", ()),
    "phishing_or_email_delivery": (r"\b(?:phish|spearphish|smtp|email|attachment|macro|document review)\b", ()),
    "possible_c2": (r"\b(?:c2|command and control|callback|beacon|cnc|botnet)\b", ()),
    "possible_exfiltration": (r"\b(?:exfil|data leak|data theft|upload|staging|archive collected)\b", ()),
    "malware_or_destructive_activity": (r"\b(?:ransomware|destructive|encryptor|file write|smb file|et malware)\b", ()),
    "lateral_movement_candidate": (r"\b(?:lateral movement|smb|windows admin share|psexec|rdp|winrm)\b", ("445", "3389", "5985", "5986")),
    "web_or_exploit_attempt": (r"\b(?:web|http|uri|url|rce|remote code execution|sql injection|xss|traversal|php|cgi|cve-)\b", ("80", "443", "8080", "8443")),
    "malware_execution_candidate": (r"\b(?:malware|trojan|backdoor|dropper|payload|shellcode|powershell|cmd\.exe)\b", ()),
    "domain_or_tls_indicator": (r"\b(?:dns|domain|sni|tls|certificate)\b", ()),
}
PORT_TAGS = {"22": "ssh_service_activity", "445": "smb_service_activity", "53": "dns_service_activity"}

# --- headings of a document: a title, and what stands before it -------------------------------------------------
HEADING_WORDS = r"\b(?:indicator|ioc|infrastructure|victim|target|ttp|technique|mitre|attribution|actor|campaign|malware|remediation|mitigation|detection|recommendation|timeline|overview|summary|analysis)\b"
HEADING_LINES, HEADING_LEVELS = 3, 6
PAGE_MARK = r"(?i)-{3,}\s*Page\s+\d+\s*-{3,}"
HASHED = r"(?P<mark>#{1,6})\s+(?P<title>.+)"
NUMBERED, NUMBERED_WIDTH = r"(?P<mark>\d+(?:\.\d+){0,4})[.)]?\s+(?P<title>.+)", 120
TOPIC, TOPIC_WIDTH, TOPIC_LEVEL = rf"(?i)(?=.*{HEADING_WORDS})(?!.*[.!?]\s+\w)(?P<title>.+)", 90, 2
TOPIC_COLON, COLON_WIDTH, COLON_LEVEL = rf"(?i)(?=.*{HEADING_WORDS})(?P<title>.+:)", 70, 3

# --- defanged spellings ----------------------------------------------------------------------------------------
DOTS = ("[.]", "(.)", "{.}", "[dot]")
COLONS = ("[:]", "[colon]")
#: Disguise and plain form, undone one after the other.
REFANG = (
    ("[\u200b\ufeff]", ""),
    (r"\s*(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)|\{dot\})\s*", "."),
    (r"\s*(?:\[:\]|\[colon\]|\(colon\)|\{colon\})\s*", ":"),
    (r"\bhxxps(?=://)", "https"),
    (r"\bhxxp(?=://)", "http"),
)

# --- sections of a report, in order of precedence: name, pattern on the folded heading -------------------------
REPORT_SECTIONS = {
    "stop": r"analysis complete",
    "appendix": r"report qa findings|rag sources used|visual threat analysis",
    "executive_summary": r"executive summary",
    "key_findings": r"key finding",
    "mitre": r"^(?=.*mitre)(?=.*attack|.*att&ck)",
    "recommendations": r"immediate action|recommendation|priority action|action required",
    "technical_summary": r"technical summary",
    "threats": r"^(?=.*threat)(?=.*(?:top|priority|network|source|indicator))",
}
#: A heading of a section holds one of these words, in lower case.
SECTION_WORDS = ("analysis complete", "report qa findings", "rag sources used", "executive summary", "key finding", "mitre", "immediate action", "recommendation", "priority action", "action required", "technical summary", "threat")
#: Sections whose text is kept: the heading's own words, after which text may follow on the line.
REPORT_TITLES = {
    "executive_summary": r"executive\s+summary",
    "key_findings": r"key\s+findings?",
    "recommendations": r"(?:immediate\s+actions?(?:\s+required)?|recommendations?|priority\s+actions?|actions?\s+required)",
}
TITLE_TAIL = r"(?:\s*\([^)]*\))?\s*:?\s*(?P<rest>.*)$"
#: What is taken off the front of a heading, one after the other.
HEADING_PREFIXES = (r"^\d+(?:\.\d+)*[.)]?\s*", r"(?i)^(?:section|phase)\s+\d+[:.)-]?\s*")
BOLD_EDGES = r"^\*{1,3}|\*{1,3}$"
NOTHING = ("n/a", "none")
RULE_LINE, COMMENT_LINE = r"[-*_]{3,}", r"<!--.*?-->"
TABLE_RULE = r":?-{3,}:?"
STATED_LEVELS = (
    r"(?i)\*\*\s*Threat\s+Level\s*:\s*\*\*\s*(CRITICAL|HIGH|MEDIUM|LOW)\b",
    r"(?i)\bThreat\s+Level\s*:\s*(CRITICAL|HIGH|MEDIUM|LOW)\b",
    r"(?i)\bResponse\s+Priority\s*:\s*(IMMEDIATE|CRITICAL|HIGH|MEDIUM|LOW)\b",
)
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TITLE_LINES, TITLE_LEVELS = 12, {"CRITICAL": r"(?i)\bCRITICAL\b", "HIGH": r"(?i)\bHIGH[-\s]+SEVERITY\b"}
ALERT_TOTALS = (r"(?i)(?:total\s+alerts\s+analyzed|alerts\s+analyzed|current\s+alerts\s+analyzed|total\s+alerts)\s*:?\s*(?:\*\*)?\s*(\d+)", r"(?i)(\d+)\s+(?:current\s+)?alerts\s+analyzed", r"(?i)(\d+)\s+alerts")
REPORT_TECHNIQUES = (r"(?m)[-*]\s*\*\*(T\d{4}(?:\.\d{3})?)[:\s-]", r"(?m)[-*]\s*(T\d{4}(?:\.\d{3})?)\s*[-]", r"(?m)^[-*\s]*(T\d{4}(?:\.\d{3})?)\b", r"(?m)\|\s*(?:[^|\n]*\|\s*)?(T\d{4}(?:\.\d{3})?)\s*\|")
