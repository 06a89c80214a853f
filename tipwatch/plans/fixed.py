"""Fixed values as the checking SQL has them, written out once more: a changed pattern in ``functions`` fails its check.

The checking engine writes groups as \\1, knows no possessive or Unicode flags, and anchors with ^ and $.
"""

from __future__ import annotations

# ---- Fixed values: redaction rules in the order they apply: name, pattern, text kept in front of the marker ----
REDACTIONS = [
    ("pem-private-key", r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", ""),
    ("ssh-public-key", r"\bssh-(?:rsa|ed25519|dss|ecdsa-[a-z0-9-]+)\s+[A-Za-z0-9+/=]{40,}", ""),
    ("jwt", r"\beyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", ""),
    ("github-token", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b", ""),
    ("aws-access-key-id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", ""),
    ("bearer-token", r"(?i)\b(Bearer\s+)([A-Za-z0-9._\-+/=]{8,})", r"\1"),
    (
        "credential-kv",
        r"(?i)\b((?:password|passwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|session[_-]?token|auth[_-]?token|client[_-]?secret)\s*[:=]\s*['\"]?)[^\s'\"]{6,}",
        r"\1",
    ),
]
MARKER = "[REDACTED:{kind}]"

# ---- Fixed values: console markers, first listed wins ----
PANICS = [
    "Kernel panic - not syncing",
    "Oops: ",
    "BUG: ",
    "Call Trace:",
    "general protection fault",
    "Unable to handle kernel",
    "double fault",
    "watchdog: BUG: soft lockup",
    "rcu_sched detected stalls",
    "page fault in interrupt",
]

# ---- Fixed values: lines that end a running test ----
CRASHES = [
    r"Kernel panic - not syncing",
    r"\bOops\s*:",
    r"\bBUG\s*:",
    r"general protection fault",
    r"unable to handle kernel paging request",
    r"double fault",
    r"Internal error\s*:",
    r"watchdog: BUG: soft lockup",
    r"soft lockup - CPU#",
    r"rcu_(?:sched|preempt|bh) detected stalls",
    r"INFO: task .* blocked for more than",
]

# ---- Fixed values: result words of the test scripts and the status they stand for; any other word is ERROR ----
STATUSES = {
    "pass": "PASS",
    "ok": "PASS",
    "success": "PASS",
    "fail": "FAIL",
    "failed": "FAIL",
    "skip": "SKIP",
    "skipped": "SKIP",
    "error": "ERROR",
    "errored": "ERROR",
    "incomplete": "ERROR",
    "miss": "MISS",
    "done": "DONE",
}
