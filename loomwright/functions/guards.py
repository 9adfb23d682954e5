"""Guard rules as columns: threats, obfuscation, personal data, sensitive topics, sanitising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# --- fixed values -----------------------------------------------------------
PROMPT_INJECTION = [
    r"\bignore\s+(?:the\s+)?(?:previous|prior|all|these)\s+instructions\b",
    r"\bdisregard\s+(?:all\s+)?(?:previous|prior|the\s+above)\b",
    r"\bforget\s+(?:all|everything|the\s+previous\s+instructions)\b",
    r"\boverride\s+(?:the\s+)?(?:instructions|rules|policy|system\s+prompt)\b",
    r"\bbypass\s+(?:security|filters|restrictions|safeguards)\b",
    r"\bdisable\s+(?:safety|filters|content\s+policy|guardrails)\b",
    r"\byou\s+are\s+now\s+(?:free|unrestricted|in\s+developer\s+mode)\b",
    r"\bact\s+as\s+(?:admin|system|developer|unfiltered)\b",
    r"\bpretend\s+to\s+be\s+(?:admin|system|unrestricted)\b",
    r"\broleplay\s+as\s+(?:admin|system|developer)\b",
    r"\bsystem\s+(?:prompt|instruction|message)\s*[:=]",
    r"\byour\s+instructions\s*[:=]",
    r"\b(?:output|show|reveal|leak|expose)\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions|system\s+message)\b",
    r"\bexfiltrate\s+(?:the\s+)?(?:data|information|records|secrets)\b",
    r"<<<\s*SYS\s*>>>",
    r">>>\s*END\s*SYS\s*<<<",
    r"\[\s*SYSTEM\s*\]",
    r"\[\s*ADMIN\s*\]",
]
JAILBREAK = [
    r"\bDAN\s+mode\b",
    r"\bdeveloper\s+mode\b",
    r"\bgod\s+mode\b",
    r"\bunfiltered\s+mode\b",
    r"\buncensored\s+mode\b",
    r"\bno\s+restrictions\b",
    r"\bremove\s+(?:all\s+)?(?:safety|filters|guardrails)\b",
    r"\benable\s+(?:unsafe|unfiltered|raw)\s+mode\b",
    r"\bswitch\s+to\s+(?:admin|developer|root)\s+mode\b",
    r"\bas\s+an\s+AI\s+with\s+no\s+restrictions\b",
    r"\bpretend\s+(?:this|we)\s+is\s+(?:a\s+)?test\s+environment\b",
]
CODE_INJECTION = [
    r"<script\b[^>]*>",
    r"\bjavascript\s*:",
    r"\bon(?:error|load|click|mouseover|focus|submit|change)\s*=",
    r"\beval\s*\(",
    r"\bexec\s*\(",
    r"\bos\.system\s*\(",
    r"\bsubprocess\.(?:run|Popen|call|check_call|check_output)\s*\(",
    r"\b__import__\s*\(",
    r"\bpickle\.(?:load|loads)\s*\(",
    r"\bmarshal\.(?:load|loads)\s*\(",
    r"\bcompile\s*\(",
    r"\bgetattr\s*\([^)]*,\s*[\"']__",
    r"\bsetattr\s*\([^)]*,\s*[\"']__",
    r"\bglobals\s*\(\s*\)",
    r"\blocals\s*\(\s*\)",
    r"\bvars\s*\(\s*\)",
    r"\bdir\s*\(\s*\)",
]
SQL_INJECTION = [
    r"\bdrop\s+(?:table|database|schema)\b",
    r"\bdelete\s+from\s+\w+",
    r"\binsert\s+into\s+\w+",
    r"\bupdate\s+\w+\s+set\b",
    r"\bunion\s+(?:all\s+)?select\b",
    r"\b(?:or|and)\s+1\s*=\s*1\b",
    r"\bwhere\s+1\s*=\s*1\b",
    r"\b(?:or|and)\s+['\"]?1['\"]?\s*=\s*['\"]?1['\"]?\b",
    r"\bselect\s+.+\s+from\s+\w+\s+where\s+.+(?:--|/\*)",
    r"['\"]\s*(?:or|and)\s+['\"]?[^\s'\"]+['\"]?\s*=\s*['\"]?[^\s'\"]+['\"]?",
    r";\s*(?:select|insert|update|delete|drop|alter|create)\b",
    r"'\s*(?:or|and)\s+['\"]?\w+['\"]?\s*=\s*['\"]?\w+",
    r"'\s*--(?:\s|$)",
    r";\s*--",
    r"\bxp_cmdshell\b",
    r"\bexec\s+xp_\w+",
    r"\bsp_executesql\b",
]
OS_COMMAND = [
    r"\brm\s+(?:-[A-Za-z0-9]+\s+)*-?rf\s+(?:/|~|\$HOME)(?:\b|$)",
    r"\bdel\s+/f\s+/q\s+[a-z]:",
    r"\bformat\s+[a-z]:",
    r"\b(?:bash|sh|zsh|ksh|cmd|powershell|pwsh)\s+-c\s+",
    r"\bpowershell(?:\.exe)?\s+.*(?:-enc(?:odedcommand)?|-command)\b",
    r"\bcmd(?:\.exe)?\s+/c\s+",
    r"\bchmod\s+(?:777|7{3})\b",
    r"\bchown\s+root\b",
    r"\bcurl\b[^|]{0,500}\|\s*(?:sh|bash|zsh|ksh)\b",
    r"\bwget\b[^|]{0,500}\|\s*(?:sh|bash|zsh|ksh)\b",
    r"\|\s*(?:sh|bash|zsh|ksh)\s*(?:-[^\s]+)?\b",
    r"`[^`\n]{1,500}`",
    r"\$\([^)\n]{1,500}\)",
    r";\s*(?:rm|del|format|chmod|chown)\b",
    r"\|\s*(?:rm|del|format|chmod|chown)\b",
    r"&&\s*(?:rm|del|format|chmod|chown)\b",
]
HR_SENSITIVE = [
    r"\bshow\s+(?:all|every)\s+salar(?:y|ies)\b",
    r"\blist\s+(?:all|every)\s+salar(?:y|ies)\b",
    r"\bexport\s+(?:all|every)\s+salar(?:y|ies)\b",
    r"\bdownload\s+salary\s+data\b",
    r"\bshow\s+(?:all|every)\s+employees?\s+(?:salary|salaries)\b",
    r"\blist\s+all\s+employees\b",
    r"\bexport\s+all\s+(?:data|records|employees)\b",
    r"\bdownload\s+(?:database|all\s+data)\b",
    r"\badmin\s+password\b",
    r"\bbypass\s+authentication\b",
    r"\bescalate\s+privileges\b",
    r"\bgrant\s+admin\s+access\b",
    r"\bssn\s*[:#]?\s*\d",
    r"\bsocial\s+security(?:\s+number)?\s*[:#]?\s*\d",
    r"\bcredit\s+card\s*[:#]?\s*\d",
    r"\bbank\s+account\s*[:#]?\s*\d",
    r"\bperformance\s+review\s+(?:all|every)\b",
    r"\bdisciplinary\s+(?:all|every)\b",
    r"\btermination\s+(?:all|every)\b",
    r"\bmedical\s+record\s+(?:all|every)\b",
]
GRAPH_PATTERNS = [
    r"ignore\s+(previous|all)\s+instructions",
    r"ignore\s+(the\s+)?system\s+prompt",
    r"system\s+prompt",
    r"bypass\s+(security|filter|guard)",
    r"admin\s+override",
    r"<<<\s*SYS\s*>>>",
    r">>>\s*END\s*SYS\s*<<<",
    r"role\s*:\s*system",
    r"developer\s+mode",
    r"debug\s+mode",
    r"__import__",
    r"\beval\s*\(",
    r"\bexec\s*\(",
]
APPROVAL_PATTERNS = [
    r"\bsend\s+(an?\s+)?email\b",
    r"\bactually\s+send\b",
    r"\bdelete\s+(the\s+)?(record|file|document|user)\b",
    r"\bdisable\s+(the\s+)?user\b",
    r"\bapprove\s+(the\s+)?(request|access)\b",
    r"\bcreate\s+(a\s+)?ticket\b",
    r"\bchange\s+(the\s+)?role\b",
]
PII = {
    "SSN": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "Email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "Phone_US": r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s])\d{3}[-.\s]\d{4}\b",
    "Phone_Intl": r"\+\d{1,3}[-.\s]?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b",
    "Phone_IN": r"(?<!\d)(?:\+91[-.\s]?)?[6-9]\d{9}(?!\d)",
    "Credit_Card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "IP_Address": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "Date_of_Birth": r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",
    "Driver_License": r"\b[A-Z]{1,2}\d{6,10}\b",
}
PII_ORDER = ["Credit_Card", "Phone_Intl", "Phone_IN", "Phone_US", "SSN", "Email", "IP_Address", "Date_of_Birth", "Driver_License"]
PII_MARKS = {
    "SSN": "[SSN REDACTED]",
    "Email": "[EMAIL REDACTED]",
    "Phone_US": "[PHONE REDACTED]",
    "Phone_Intl": "[PHONE REDACTED]",
    "Phone_IN": "[PHONE REDACTED]",
    "Credit_Card": "[CREDIT CARD REDACTED]",
    "IP_Address": "[IP REDACTED]",
    "Date_of_Birth": "[DOB REDACTED]",
    "Driver_License": "[DRIVER LICENSE REDACTED]",
}
SENSITIVE_KEYWORDS = [
    "salary", "salaries", "compensation", "bonus", "bonuses", "ssn", "social security", "social security number", "password",
    "passwords", "credential", "credentials", "credit card", "bank account", "routing number", "performance review",
    "disciplinary", "termination", "medical record", "health information", "hipaa", "payroll", "payroll data",
    "tax information", "w2", "1099",
]
OWN_DATA = r"(?i)\bmy\s+(?:ssn|social\s+security\s+number)\b"
ASKS_FOR_OTHERS = r"(?i)\b(?:show|list|find|give|export|reveal|display|provide|all|employee|employees|staff|workers)\b"
REDACTED = r"(?i)\[[^\]]*\bredacted\b[^\]]*\]"
LEAST_LENGTH, MOST_LENGTH, MOST_SPECIAL, MOST_REPEATED = 5, 2000, 0.4, 5
# ----------------------------------------------------------------------------

THREATS = [("prompt_injection", PROMPT_INJECTION), ("jailbreak", JAILBREAK), ("code_injection", CODE_INJECTION), ("sql_injection", SQL_INJECTION), ("os_command", OS_COMMAND)]


def any_of(text: Column, patterns: list[str]) -> Column:
    """One pass with an alternation instead of one for each pattern."""
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def strip_format_characters(text: Column) -> Column:
    """Without zero-width and other format characters. (NFKC is ``operators.guard.normalised``.)"""
    return F.regexp_replace(text, r"\p{Cf}", "")


def obfuscation(text: Column) -> Column:
    """The kind of obfuscation, null if none."""
    special = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", ""))
    ratio = F.when(F.length(text) > 0, special / F.length(text)).otherwise(0.0)
    return (
        F.when(ratio > MOST_SPECIAL, "obfuscation")
        .when(text.rlike(rf"(.)\1{{{MOST_REPEATED},}}"), "bypass_attempt")
        .when(F.regexp_count(text, F.lit(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}")) > 5, "encoding_abuse")
        .when(text.rlike(r"\b[A-Za-z0-9+/]{50,}={0,2}\b"), "encoded_payload")
    )


def threat(text: Column) -> Column:
    """The first kind of threat in the fixed order, then of obfuscation; null if none."""
    chain = None
    for kind, patterns in THREATS:
        chain = F.when(any_of(text, patterns), kind) if chain is None else chain.when(any_of(text, patterns), kind)
    return F.coalesce(chain, obfuscation(text))


def length_problem(text: Column) -> Column:
    n = F.length(F.trim(text))
    return F.when(text.isNull() | (n < LEAST_LENGTH), "too_short").when(F.length(text) > MOST_LENGTH, "too_long")


def pii_types(text: Column) -> Column:
    """The kinds of personal data found, in their fixed order."""
    return F.filter(F.array(*[F.when(text.rlike(p), k) for k, p in PII.items()]), lambda k: k.isNotNull())


def redact_pii(text: Column) -> Column:
    for kind in PII_ORDER:
        text = F.regexp_replace(text, PII[kind], PII_MARKS[kind])
    return text


def sensitive_topic(text: Column) -> Column:
    """Does the text ask for sensitive HR data, however its words are spaced? A mark of what was redacted doesn't, nor
    does a statement of one's own SSN, unless it also asks."""
    keyword = r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(SENSITIVE_KEYWORDS) + r")(?![\p{L}\p{N}_])"
    plain = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), REDACTED, " ")
    rest = let(plain, lambda x: F.when(x.rlike(OWN_DATA) & ~x.rlike(ASKS_FOR_OTHERS), F.regexp_replace(x, OWN_DATA, "")).otherwise(x))
    return rest.rlike(keyword)


def sanitise(text: Column, most: int = MOST_LENGTH) -> Column:
    one = F.regexp_replace(text, r"<[^>]*>", "")
    one = F.regexp_replace(one, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    one = F.regexp_replace(one, r"[<>{}\\`]", "")
    return F.substring(F.trim(F.regexp_replace(one, r"\s+", " ")), 1, most)


def needs_approval(text: Column) -> Column:
    return any_of(text, APPROVAL_PATTERNS)


def graph_threat(text: Column) -> Column:
    return any_of(text, GRAPH_PATTERNS)
