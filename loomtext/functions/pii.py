"""Personal data and secrets: ordered redaction, and presence by kind.  All native, with Unicode classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let

MARK = "[REDACTED]"
# What each kind looks like.  Order matters: phones are taken before addresses and numbers of persons.
# The bar among the letters of a domain's end is part of the value.  Names of addresses have 64 characters at most and
# domains 255, as mail allows; without a bound, time would grow with the square of a run such as a-a-a-a.
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Z|a-z]{2,}\b"
EMAIL_BRACKETED = r"(?iuU)\b([A-Za-z0-9._%+-]{1,64})\s*(?:\[at\]|\(at\)|\{at\}|<at>|AT|@)\s*([A-Za-z0-9.-]{1,255})\s*(?:\[dot\]|\(dot\)|\{dot\}|<dot>|DOT|\.)\s*([A-Za-z]{2,})\b"
# The same without prose such as "that anecdote": a bare AT or DOT is a word of its own, or stands in upper case among other letters.
EMAIL_BRACKETED_WORDS = (
    r"(?iuU)\b([A-Za-z0-9._%+-]{1,64})(?:\s*(?:\[at\]|\(at\)|\{at\}|<at>|@|(?-i:(?<!\p{Lu})AT(?!\p{Lu})))\s*|\s+AT\s+)"
    r"([A-Za-z0-9.-]{1,255})(?:\s*(?:\[dot\]|\(dot\)|\{dot\}|<dot>|\.|(?-i:(?<!\p{Lu})DOT(?!\p{Lu})))\s*|\s+DOT\s+)([A-Za-z]{2,})\b"
)
EMAIL_SPELT = r"(?iuU)\b([A-Za-z0-9._%+-]{2,64})\s+at\s+([A-Za-z0-9.-]{2,255})\s+dot\s+([A-Za-z]{2,})\b"
PHONE_INTERNATIONAL = r"(?U)\+\d{1,3}[\s.-]?\(?\d{1,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}(?:[\s.-]?\d{1,4})?"
PHONE_RUSSIAN = r"(?U)\b8[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2}\b"
PHONE = r"(?U)\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
IP = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
KEY_VALUE = r"""(?iuU)\b((?:api[_-]?key|apikey|access[_-]?token|auth[_-]?token|secret|secret[_-]?key|client[_-]?secret|password|passwd|pwd)\s*[:=]\s*["']?)([A-Za-z0-9_\-./+=]{8,})(["']?)"""
TOKEN_VALUE = r"""(?iuU)\b(token\s*[:=]\s*["']?)([A-Za-z0-9_\-./+=]{8,})(["']?)"""
BEARER = r"(?iuU)\b((?:Bearer|Authorization\s*:\s*Bearer)\s+)([A-Za-z0-9_\-./+=]{8,})"
BARE_TOKENS = (
    r"sk-[A-Za-z0-9_-]{20,}", r"ghp_[A-Za-z0-9]{36,}", r"github_pat_[A-Za-z0-9_]{40,}", r"gho_[A-Za-z0-9]{36,}", r"ghu_[A-Za-z0-9]{36,}",
    r"ghr_[A-Za-z0-9]{36,}", r"xox[baprs]-[A-Za-z0-9-]{10,}", r"(?U)\bAKIA[0-9A-Z]{16}\b",
    r"(?U)\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
)
GITHUB_USER = r"(?iu)(github\.com/)(@)([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}[A-Za-z0-9])?)"
GIT_SSH = r"(?iu)(git@)(github\.com)(:[A-Za-z0-9][A-Za-z0-9-]{0,38}/)"


def _doubled(pattern: str) -> str:
    """Assignments whose key holds its value, as in password=password, where both go."""
    flags, _, rest = pattern.partition(")")
    keys = rest.removeprefix("\\b(").partition("\\s*[:=]")[0]
    return flags + r""")\b(?=""" + keys + r"""\s*[:=]\s*["']?([A-Za-z0-9_\-./+=]{8,}))([a-z_\-]*?)(?-i:\1)([a-z_\-]*\s*[:=]\s*["']?)(?-i:\1)"""


KEY_IN_KEY = _doubled(KEY_VALUE)

#: What stands in every match of a pattern: a text for some, for the others a pattern that is cheaper to look for.
_SIGNS = {EMAIL: "@", SSN: "-", PHONE_INTERNATIONAL: "+"} | dict(zip(BARE_TOKENS, ("sk-", "ghp_", "github_pat_", "gho_", "ghu_", "ghr_", "xox", "AKIA", "eyJ"), strict=True))
_SIGN_PATTERNS = {
    EMAIL_BRACKETED: r"(?iuU)(?:at|@)[\])}>]?\s*[a-z0-9.-]{1,255}\s*[\[({<]?(?:dot|\.)[\])}>]?\s*[a-z]{2}", EMAIL_SPELT: r"(?iuU)\sdot\s", PHONE_RUSSIAN: r"\p{Nd}{3}", PHONE: r"\p{Nd}{3}",
    IP: r"\p{Nd}\.\p{Nd}", KEY_IN_KEY: r"(?iu)(key|token|secret|passw|pwd)[a-z_-]*\s*[:=]", KEY_VALUE: r"(?iu)key|token|secret|passw|pwd", TOKEN_VALUE: r"(?iu)token", BEARER: r"(?iu)bearer",
    GITHUB_USER: r"(?iu)github\.com/@", GIT_SSH: r"(?iu)git@github",
}
_SIGN_PATTERNS[EMAIL_BRACKETED_WORDS] = _SIGN_PATTERNS[EMAIL_BRACKETED]


def _quoted(mark: str) -> str:
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def signed(t: Column, pattern: str) -> Column:
    """Whether a text has what a match needs; a text that hasn't can't match, and looking for it is far cheaper."""
    return t.contains(_SIGNS[pattern]) if pattern in _SIGNS else t.rlike(_SIGN_PATTERNS[pattern])


def steps(mark: str = MARK, words: bool = False) -> list[tuple[str, str]]:
    """The patterns in their order, with what takes a match's place; ``words`` leaves AT and DOT inside words alone."""
    m, fixed = _quoted(mark), _quoted(MARK)
    three = f"$1 {m} $2 {m} $3"
    return [
        (EMAIL, m), (EMAIL_BRACKETED_WORDS if words else EMAIL_BRACKETED, three), (EMAIL_SPELT, three), (PHONE_INTERNATIONAL, m), (PHONE_RUSSIAN, m), (PHONE, m), (IP, m), (SSN, m),
        (KEY_IN_KEY, f"$2{fixed}$3{fixed}"), (KEY_VALUE, f"$1{fixed}$3"), (TOKEN_VALUE, f"$1{fixed}$3"), (BEARER, f"$1{fixed}"),
        *((p, m) for p in BARE_TOKENS), (GITHUB_USER, f"$1{m}"), (GIT_SSH, f"git{m}$2$3"),
    ]


def _when_signed(pattern: str, to: str):
    return lambda x: F.when(signed(x, pattern), F.regexp_replace(x, pattern, to)).otherwise(x)


def remove_pii(c: Column | str, mark: str = MARK, words: bool = False) -> Column:
    """The text with addresses, phones, numbers and secrets replaced.  Values that are assigned to a key are replaced, their key stays
    unless it holds the value itself.  ``words`` leaves words such as "that anecdote", which hold AT and DOT, as they are."""
    t = col(c)
    for pattern, to in steps(mark, words):
        t = let(t, _when_signed(pattern, to))
    return t


KINDS = {
    "email": (EMAIL, EMAIL_BRACKETED, EMAIL_SPELT), "phone": (PHONE_INTERNATIONAL, PHONE_RUSSIAN, PHONE), "ip": (IP,), "ssn": (SSN,),
    "api_key_or_token": (KEY_VALUE, TOKEN_VALUE, BEARER), "bare_token": BARE_TOKENS, "github_cred_url": (GITHUB_USER, GIT_SSH),
}


def has_pii(c: Column | str, kind: str) -> Column:
    hit = F.lit(False)
    for p in KINDS[kind]:
        t = F.coalesce(col(c), F.lit(""))
        hit = hit | (signed(t, p) & t.rlike(p))
    return hit


def detect_pii(c: Column | str) -> Column:
    """Map of the kinds present, each to 1."""
    entries = [F.when(has_pii(c, k), F.struct(F.lit(k).alias("key"), F.lit(1).alias("value"))) for k in KINDS]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


PIIKINDS = tuple(KINDS)


def clean_pairs(df, mark: str = MARK, conversation: bool = True):
    """Redacts prompt and completion, and the turns of a conversation too unless told not to; AT and DOT inside words are no address."""
    df = df.withColumns({c: remove_pii(c, mark, words=True) for c in ("prompt", "completion")})
    if conversation and "conversation" in df.columns:
        df = df.withColumn("conversation", F.transform("conversation", lambda t: t.withField("content", remove_pii(t["content"], mark, words=True))))
    return df
