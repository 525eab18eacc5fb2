"""Task texts: kind, terms and mentioned files."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that decide a task's kind, in test order.
TASK_KINDS = [
    ("feature", ["add", "create", "implement", "build"]),
    ("bug", ["fix", "bug", "error", "issue"]),
    ("refactor", ["refactor", "improve", "optimize", "clean"]),
    ("investigation", ["investigate", "understand", "analyze", "explore"]),
    ("documentation", ["document", "docs", "readme"]),
]

# Vocabulary of actions, framework concepts, domain concepts and stop words.
ACTION_VERBS = [
    "add", "create", "implement", "build", "fix", "resolve", "refactor", "improve", "optimize", "update", "modify",
    "remove", "delete", "investigate", "debug", "test", "document",
]
FRAMEWORK_CONCEPTS = [
    "component", "hook", "composable", "store", "provider", "context", "state", "reducer", "action", "middleware",
    "route", "navigation", "screen", "page", "layout", "api", "service", "util", "helper", "model", "type", "interface",
    "gesture", "animation", "touchable", "flatlist", "scrollview", "modal", "tab", "drawer", "stack", "native",
    "platform", "ios", "android", "expo",
    "plugin", "module", "directive", "computed", "reactive", "ref", "watch", "pinia", "vuex", "vite", "nitro", "server",
    "ssr", "ssg", "hydration", "teleport", "transition", "suspense", "emits", "props", "slots",
]
DOMAIN_CONCEPTS = [
    "auth", "login", "signup", "user", "profile", "payment", "checkout", "cart", "product", "order", "shipping",
    "notification", "email", "search", "filter", "sort", "upload", "download", "form", "validation", "error", "loading",
    "dashboard", "admin", "settings", "analytics",
    "camera", "photo", "image", "location", "map", "gps", "permission", "push", "biometric", "fingerprint", "face-id",
    "share", "haptic", "vibration", "orientation", "accelerometer", "sensor", "bluetooth", "nfc", "storage",
    "asyncstorage", "deeplink", "universal-link",
]
STOP_WORDS = [
    "the", "and", "for", "with", "that", "this", "from", "have", "will", "can", "should", "would", "could", "need",
    "want", "make", "use", "work",
]
# Folders that a mentioned path starts with.
MENTION_ROOTS = ["src/", "components/", "pages/", "app/", "lib/"]
MENTION = rf"(?:{'|'.join(MENTION_ROOTS)})[\w/-]+\.[\w]+"


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def task_kind(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit("general")
    for kind, words in reversed(TASK_KINDS):
        out = F.when(F.exists(_words(words), lambda w: low.contains(w)), kind).otherwise(out)
    return out


def keywords(text: Column) -> Column:
    """Distinct words of at least four characters without stop words."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(r"\w{4,}"), F.lit(0)), _words(STOP_WORDS))


def listed(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return F.filter(_words(words), lambda w: low.contains(w))


def mentioned_files(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)))


def mentions_of_path(path: Column) -> Column:
    """Every text that, mentioned in a task, would name this path."""
    starts = F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: F.exists(
        _words(MENTION_ROOTS), lambda r: F.substr(path, i).startswith(r)))
    def forms(i):
        rest = F.substr(path, i)
        whole = F.length(F.regexp_extract(rest, r"^[\w/-]+\.\w+", 0))
        base = F.length(F.regexp_extract(rest, r"^[\w/-]+\.", 0))
        ends = F.when(whole > base, F.sequence(base + 1, whole)).otherwise(F.array().cast("array<int>"))
        return F.transform(ends, lambda k: F.substr(rest, F.lit(1), k))
    return F.array_distinct(F.flatten(F.transform(starts, forms)))
