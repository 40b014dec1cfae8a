"""Rules for file names and texts that must not be published."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from albumloom.functions.times import let

# fixed values: blocked folders, suffixes and document prefixes
BLOCKED_DIRS = ["blog/", "test/", "docs/"]
BLOCKED_SUFFIXES = [".keystore", ".jks", ".p12", ".pfx"]
BLOCKED_PREFIXES = ["用户操作手册", "运维操作手册"]


@dataclass(frozen=True)
class NameRules:
    """Exact names are a site's own list; ``open_root`` is a folder whose test/ subfolders may be published."""

    dirs: list[str] = field(default_factory=lambda: list(BLOCKED_DIRS))
    names: list[str] = field(default_factory=lambda: ["local.properties", "local.properties.local"])
    suffixes: list[str] = field(default_factory=lambda: list(BLOCKED_SUFFIXES))
    prefixes: list[str] = field(default_factory=lambda: list(BLOCKED_PREFIXES))
    open_root: str = "android/"


def blocked_name(name: Column, rules: NameRules = NameRules()) -> Column:
    """First rule a file name breaks, null when none."""
    path = F.replace(name, F.lit("\\"), F.lit("/"))
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    hit = F.when(F.lit(False), "")
    for d in rules.dirs:
        inside = F.startswith(path, F.lit(d)) | F.contains(path, F.lit("/" + d))
        if d == "test/":
            inside = inside & ~F.startswith(path, F.lit(rules.open_root))
        hit = hit.when(inside, f"dir {d}")
    for n in rules.names:
        hit = hit.when(name == n, f"name {n}")
    for s in rules.suffixes:
        hit = hit.when(F.endswith(base, F.lit(s)), f"suffix {s}")
    for p in rules.prefixes:
        hit = hit.when(F.startswith(base, F.lit(p)), f"prefix {p}")
    return hit


# fixed values: content patterns, matched without case; the last part is text every match holds
BLOCK_PATTERNS = [
    ("sk key", r"sk-[A-Za-z0-9\-_]{12,}", "sk-"),
    ("ark key", r"ark-[A-Za-z0-9\-_]{12,}", "ark-"),
    ("AKID secret id", r"AKID[A-Za-z0-9]{10,}", "akid"),
    ("ghp token", r"ghp_[A-Za-z0-9]{20,}", "ghp_"),
    ("github_pat token", r"github_pat_[A-Za-z0-9_]{20,}", "github_pat_"),
    ("private key", r"-----BEGIN [ A-Z]*PRIVATE KEY-----", "private key-----"),
    ("map service key", r"amap.{0,60}?[\"']?([0-9a-f]{32})[\"']?", "amap"),
]
PRIVATE_IP = r"\b(10|172\.(1[6-9]|2\d|3[01])|192\.168)\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[a-zA-Z]{2,}"
PASSWORD = r"(password|passwd|pwd|secret|auth_token)\s*[:=]\s*[\"']([^\"']{4,})[\"']"
LONG_TOKEN = r"\b[A-Za-z0-9\+/_-]{40,}\b"
PASSWORD_WORDS = ["password", "passwd", "pwd", "secret", "auth_token"]
PLACEHOLDERS = ["xxx", "your", "<", "example", "placeholder", "todo", "changeme", "passw", "token", "key", "xxxx"]
MAIL_PLACEHOLDERS = ["example.com", "example.org", "your-"]
EXCERPT = 60


def is_placeholder(value: Column) -> Column:
    """Looks like a sample value: holds a hint word, or is short and has no digit."""
    return F.lower(value).rlike("|".join(PLACEHOLDERS)) | (~value.rlike("[0-9]") & (F.length(value) < 12))


def findings(name: Column, text: Column, own_mail: str = "", own_domain: str = "") -> Column:
    """Array of (level, rule, excerpt): every match of every rule, found in one pass over the row.

    ``own_mail`` is an address published on purpose, ``own_domain`` a domain to warn about. A pattern runs only
    on texts that hold what each of its matches must hold.
    """
    # the one letter that equals s without case yet stays itself in lower case
    return let(F.replace(F.lower(text), F.lit("\u017f"), F.lit("s")), lambda low: _findings(name, text, low, own_mail, own_domain))


def _findings(name: Column, text: Column, low: Column, own_mail: str, own_domain: str) -> Column:
    def each(pattern: str, holds: Column, group: int = 0) -> Column:
        return F.when(holds, F.regexp_extract_all(text, F.lit("(?iU)" + pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))

    def word(*words: str) -> Column:
        hit = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            hit = hit | F.contains(low, F.lit(w))
        return hit

    def row(level: Column | str, rule: Column | str, match: Column) -> Column:
        as_col = [F.lit(x) if isinstance(x, str) else x for x in (level, rule)]
        return F.struct(as_col[0].alias("level"), as_col[1].alias("rule"), F.substring(match, 1, EXCERPT).alias("excerpt"))

    def block(rule: str, pattern: str, part: str) -> Column:
        return F.transform(each(pattern, word(part)), lambda m: row("BLOCK", rule, m))

    parts = [block(*b) for b in BLOCK_PATTERNS]
    parts.append(F.transform(each(PRIVATE_IP, word("10.", "172.", "192.168.")), lambda m: row("WARN", "private address", m)))
    allowed = "|".join([h.replace(".", r"\.") for h in MAIL_PLACEHOLDERS + ([own_mail] if own_mail else [])])
    mails = F.filter(each(MAIL, word("@")), lambda m: ~F.substring(m, 1, EXCERPT).rlike(allowed))
    parts.append(F.transform(mails, lambda m: row("WARN", "mail address", m)))
    if own_domain:
        parts.append(F.transform(each(own_domain.replace(".", r"\."), word(own_domain.lower())), lambda m: row("WARN", "own domain", m)))
    said = word(*PASSWORD_WORDS)
    held = F.arrays_zip(each(PASSWORD, said).alias("m"), each(PASSWORD, said, 2).alias("v"))
    parts.append(
        F.transform(
            held,
            lambda z: row(
                F.when(is_placeholder(z["v"]), "WARN").otherwise("BLOCK"),
                F.when(is_placeholder(z["v"]), "password placeholder").otherwise("password"),
                z["m"],
            ),
        )
    )
    long = F.filter(each(LONG_TOKEN, text.rlike(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40}")), lambda m: ~is_placeholder(F.substring(m, 1, EXCERPT)) & ~F.endswith(name, F.lit(".enc")))
    parts.append(F.transform(long, lambda m: row("WARN", "long token", m)))
    return F.concat(*parts)
