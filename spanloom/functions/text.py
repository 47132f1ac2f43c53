"""Column functions on paths, names and texts; all of them JVM-side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories, names and endings that are never indexed.
SKIP_DIRS = [".git", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".spanloom", ".next", "target"]
LOCKFILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "uv.lock"]
NOISE_ENDINGS = ["png", "jpg", "jpeg", "gif", "webp", "zip", "tar", "gz", "wasm", "woff", "woff2"]
# Fixed value: contents that look like secrets.
SECRET_CONTENT = r"-----BEGIN [A-Z ]*PRIVATE KEY-----|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}"
MAX_FILE_BYTES = 1_048_576
# Language tags by file ending (any case).
LANGUAGES = {
    "python": ["py"],
    "tsx": ["tsx", "jsx"],
    "typescript": ["ts"],
    "javascript": ["js", "mjs", "cjs"],
    "markdown": ["md", "mdx"],
    "css": ["css", "scss"],
    "graphql": ["graphql", "gql"],
    "json": ["json"],
    "yaml": ["yaml", "yml"],
}
#: Punctuation that is cut off both ends of a query word.
TRIMMED = "?!,;:()[]{}'\""

# A map from letters with one accent to their base letters, built by decomposition: the Latin blocks up to U+024F and U+1E00 to U+1EFF.
_ACCENTED = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) == 2 and unicodedata.combining(d[1])]
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)
_ACCENTS = "".join(_ACCENTED)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last ending; a name that only begins with a dot has none."""
    return F.regexp_replace(basename(path), r"(?s)^(.+)\.[^.]*$", "$1")


def in_skip_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_DIRS)))


def is_secret_name(path: Column) -> Column:
    return basename(path).rlike(r"^(?:\.env(?:\..*)?|id_rsa|credentials\.json|.*\.(?i:pem|key))$")


def is_noise_name(path: Column) -> Column:
    name = basename(path)
    return name.isin(*LOCKFILES) | name.rlike(rf"\.(?:min\.js|map|{'|'.join(NOISE_ENDINGS)})$")


def skip_kind(path: Column, content: Column, size: Column, ignored: Column | None = None) -> Column:
    """Why a file is left out, or ``keep``: the first rule that holds. Null content is judged by name and size only."""
    return (
        F.when(in_skip_dir(path), "ignore")
        .when(is_secret_name(path), "secret_name")
        .when(is_noise_name(path), "ignore")
        .when(F.coalesce(F.contains(content, F.lit("\0")), F.lit(False)), "binary")
        .when(size > MAX_FILE_BYTES, "large")
        .when(F.coalesce(content.rlike(SECRET_CONTENT), F.lit(False)), "secret_content")
        .when(ignored if ignored is not None else F.lit(False), "ignore")
        .otherwise("keep")
    )


def language(path: Column) -> Column:
    name = F.lower(path)
    out = None
    for tag, endings in LANGUAGES.items():
        test = name.rlike(rf"\.(?:{'|'.join(endings)})$")
        out = F.when(test, tag) if out is None else out.when(test, tag)
    return out


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def tokens(text: Column) -> Column:
    """Full-text tokens: runs of letters and digits, lower case, without diacritics; combining accents belong to no letter and cut no token.

    A text of as many characters as bytes has no accents, and is not looked through for them.
    """
    folded = F.regexp_replace(F.translate(F.lower(text), _ACCENTS, _PLAIN), r"[\x{300}-\x{36F}]+", "")
    bare = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)
    return F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def token_cost(text: Column) -> Column:
    """Words and two."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) + 2


def lines(text: Column) -> Column:
    """Lines of a text as quoted: without line ends, and none after a last line end."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n\\z", ""), "\n"))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (1-based, inclusive), joined."""
    each = lines(text)
    first = F.greatest(start, F.lit(1))
    count = F.greatest(F.least(end, F.size(each)) - first + 1, F.lit(0))
    return F.array_join(F.slice(each, first, count), "\n")


def cut(text: Column, most: int) -> Column:
    """At most ``most`` characters, with an ellipsis where something was cut."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def stem_matches(path: Column, token: Column) -> Column:
    """The file's stem is the token, or goes on from it with ``_`` or ``-``; case aside."""
    s, t = F.lower(stem(path)), F.lower(token)
    return (t != "") & ((s == t) | F.startswith(s, F.concat(t, F.lit("_"))) | F.startswith(s, F.concat(t, F.lit("-"))))


def commit_text(subject: Column, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) == "", subject).otherwise(F.concat(subject, F.lit("\n\n"), body))
