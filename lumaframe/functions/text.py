"""Recognised on-screen text: handles, noise, platform signals. Column expressions without any UDF.

Word characters and white space are those of Unicode, as the texts come in many languages: Java's own \\w and \\s are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, phrases and patterns that decide the results.
NOISE_WORDS = (
    "live", "share", "send", "follow", "following", "followers", "comment", "comments", "likes", "like", "reply", "search",
    "explore", "reels", "home", "profile", "saved", "settings", "viewers", "viewer", "watching",
    "ao", "vivo", "entrou", "procurar", "ver", "traducao", "compartilhar", "seguir", "seguindo", "seguidores", "curtir",
    "diretta", "cerca", "condividi", "segui",
    "buscar", "compartir", "gusta",
    "direct", "rechercher", "partager", "suivre",
    "suchen", "teilen", "folgen",
    "tiktok", "instagram", "reel",
    "the", "and", "for", "you", "your", "with", "this", "that", "from", "have", "has", "had", "not", "are", "was", "were",
    "been", "can", "how", "long", "hold", "show", "some", "well", "done", "always", "enjoying", "time", "together", "our",
    "bye", "hey", "omg", "lol", "wow",
)
LIVE_BADGES = ("ao vivo", "in diretta", "en vivo", "en direct")
WEAK_SIGNS = ("entrou", "seguidores", "seguindo", "curtir")
CHROME = r"(?i)^(ao vivo|in diretta|live|en vivo|en direct)"
MARKER = "Extracted Username:"
PLATFORM_A, PLATFORM_B = "TikTok", "Instagram"
PLATFORM_THRESHOLD = 10
SHORTEST, LONGEST = 4, 30
HOST_BOOST = 30
NEAR_BADGE, AFTER_KEYWORD = 8, 3

SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_.]"
HANDLE = "@" + SPACE + "{0,2}(" + WORD + "{4,30})"
KEYWORD = "(?i)tik" + SPACE + "*tok"
_EDGES = ".,;:!?()[]{}\"'"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def words_of(c: Column) -> Column:
    """Split at white space; no empty words."""
    return F.regexp_extract_all(c, F.lit(f"[^{SPACE[1:-1]}]+"), 0)  # unlike split, it keeps its compiled pattern


def lines_of(c: Column) -> Column:
    return F.split(c, "\n")


def _indexes(a: Column) -> Column:
    """0 up to the last index; empty for an empty array."""
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), lambda i: i < F.size(a))


def normalized_username(raw: Column) -> Column:
    """Without leading @, outer white space, trailing . , ; : ! ? and leading dots; underscores stay."""
    bare = strip(F.regexp_replace(raw, "^@+", ""))
    return F.regexp_replace(F.regexp_replace(bare, r"[.,;:!?]+$", ""), r"^\.+", "")


def is_noise(word: Column) -> Column:
    """Likely a word of the user interface rather than a username."""
    w = F.btrim(F.lower(word), F.lit("._"))
    return (
        (F.length(w) < SHORTEST)
        | (F.length(w) > LONGEST)
        | w.rlike(r"^\p{Nd}+$")
        | w.rlike(r"^\p{Nd}{1,2}:\p{Nd}{2}")
        | w.rlike(r"^\p{Nd}+%$")
        | w.isin(*NOISE_WORDS)
        | ((F.upper(word) == word) & (F.lower(word) != word) & (F.length(word) < 8))
    )


def _named(raw: Column, score: Column) -> Column:
    return F.struct(normalized_username(raw).alias("username"), score.cast("bigint").alias("score"))


def _good(c: Column) -> Column:
    return (c["username"] != "") & ~is_noise(c["username"])


def _handles(text: Column, score: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(HANDLE), 1)
    return F.filter(F.transform(found, lambda h: _named(h, F.lit(score))), _good)


def _word_score(name: Column) -> Column:
    return (
        F.when(name.contains("_") | (name.contains(".") & ~name.endswith(".")), 7)
        .when(name.rlike(r"(?i)[a-z]\p{Nd}|\p{Nd}[a-z]"), 5)
        .when(name.rlike("[a-z][A-Z]"), 5)
        .when(F.length(name) > 10, 2)
        .otherwise(0)
    )


def _standalone(line: Column) -> Column:
    words = F.when(~line.rlike(CHROME.replace("^", f"^{SPACE}*")), words_of(line)).otherwise(F.array().cast("array<string>"))
    bare = F.transform(words, lambda w: F.btrim(w, F.lit(_EDGES)))
    plain = F.filter(bare, lambda w: w.rlike(r"^[a-zA-Z][\p{L}\p{N}_.]{2,29}$"))
    # such a word is its own normalized form: it begins with a letter, and its edges are trimmed
    named = F.transform(plain, lambda w: F.struct(w.alias("username"), _word_score(w).cast("bigint").alias("score")))
    return F.filter(named, lambda c: (c["score"] > 0) & _good(c))


def usernames(text: Column) -> Column:
    """Array of (username, score), a bag in order of discovery: handles anywhere, handles in the three lines from each
    keyword line on (blocks may overlap and count again), and words that look like a name. Null text gives null."""
    lines = lines_of(text)
    near = F.flatten(
        F.transform(
            F.filter(_indexes(lines), lambda i: F.get(lines, i).rlike(KEYWORD)),
            lambda i: _handles(F.array_join(F.slice(lines, i + 1, AFTER_KEYWORD), "\n"), 15),
        )
    )
    none = F.array().cast("array<struct<username:string,score:bigint>>")
    return F.concat(_handles(text, 10), F.when(text.rlike(KEYWORD), near).otherwise(none), F.flatten(F.transform(lines, _standalone)))


def host_names(text: Column) -> Column:
    """Distinct usernames within eight lines of a line with a live badge."""
    lines = lines_of(text)

    def badge(line: Column) -> Column:
        low = F.lower(line)
        found = low.contains(LIVE_BADGES[0])
        for b in LIVE_BADGES[1:]:
            found = found | low.contains(b)
        return found

    def window(i: Column) -> Column:
        first = F.greatest(i - NEAR_BADGE, F.lit(0))
        return F.transform(usernames(F.array_join(F.slice(lines, first + 1, i + NEAR_BADGE + 1 - first), "\n")), lambda c: c["username"])

    names = F.array_distinct(F.flatten(F.transform(F.filter(_indexes(lines), lambda i: badge(F.get(lines, i))), window)))
    return F.when(badge(text), names).otherwise(F.array().cast("array<string>"))


def platform_a_score(text: Column) -> Column:
    """10 for the keyword, 5 for each line that is little more than a handle."""

    def mark(line: Column) -> Column:
        rest = F.regexp_replace(line, "@" + SPACE + "{0,2}" + WORD + "+", "")
        return strip(line).rlike(HANDLE) & (F.size(F.filter(words_of(rest), lambda w: F.length(w) > 1)) <= 2)

    return (F.when(text.rlike(KEYWORD), 10).otherwise(0) + 5 * F.size(F.filter(lines_of(text), mark))).cast("bigint")


def platform_b_score(text: Column) -> Column:
    """10 for each live badge that occurs, 3 for each weaker sign."""
    low = F.lower(text)
    total = F.lit(0)
    for phrase in LIVE_BADGES:
        total = total + F.when(low.contains(phrase), 10).otherwise(0)
    for word in WEAK_SIGNS:
        total = total + F.when(low.contains(word), 3).otherwise(0)
    return total.cast("bigint")


def details_with(details: Column, username: Column) -> Column:
    """The marker line, and below it what was there."""
    line = F.concat(F.lit(MARKER + " @"), username)
    return F.when(F.coalesce(details, F.lit("")) == "", line).otherwise(F.concat(line, F.lit("\n\n"), details))
