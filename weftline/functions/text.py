"""Column builders over text: tokenizers, extractors, paths, chunks. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+"
UNICODE_IDENTIFIER = r"[\p{L}_$][\p{L}\p{N}_$]*|[0-9]+"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def identifier_tokens(text: Column, unicode: bool = False) -> Column:
    """T01. Each identifier or number in lower case, followed by its camel-case and underscore parts unless equal to it.

    Letters are ASCII, so accented words fall apart; unicode=True keeps them whole.
    """

    def own(raw: Column) -> Column:
        whole = F.lower(raw)
        apart = F.replace(F.regexp_replace(raw, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" "))
        parts = F.filter(F.transform(F.split(apart, " +"), F.lower), lambda p: (p != "") & (p != whole))
        return F.concat(F.array(whole), parts)

    return F.flatten(F.transform(_all(text, UNICODE_IDENTIFIER if unicode else IDENTIFIER), own))


def identifier_bag(text: Column) -> Column:
    """T01 in any order: the same tokens as identifier_tokens, for counting. Only texts with compound names pay for parts."""
    safe = F.coalesce(text, F.lit(""))
    whole = _all(F.translate(safe, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[a-z_$][a-z0-9_$]*|[0-9]+")

    def parts(raw: Column) -> Column:
        apart = F.replace(F.regexp_replace(raw, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" "))
        return F.filter(F.transform(F.split(apart, " +"), F.lower), lambda p: (p != "") & (p != F.lower(raw)))

    compound = "_|[a-z0-9][A-Z]"
    named = F.filter(_all(text, IDENTIFIER), lambda t: t.rlike(compound))
    return F.when(safe.rlike(compound), F.concat(whole, F.flatten(F.transform(named, parts)))).otherwise(whole)


def aliases(name: Column) -> Column:
    """T02. Ordered distinct lower-case parts of a name at case borders, separators and other signs."""
    spaced = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"([a-z0-9$])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(F.regexp_replace(spaced, r"[\\/_\-\.\s]+", " "), r"[^A-Za-z0-9$\s]+", " ")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), r"\s+"), lambda t: t != ""))


def signal_tokens(text: Column, least: int = 3) -> Column:
    """T03. Distinct tokens of [a-z0-9_] with at least so many signs."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+"), lambda t: F.length(t) >= least))


def stem_tokens(path: Column) -> Column:
    """T04. Distinct tokens of over two signs of a file's stem."""
    stem = F.regexp_replace(F.regexp_extract(path, "[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    return F.array_distinct(F.filter(F.split(F.lower(stem), "[^a-zA-Z0-9]"), lambda t: F.length(t) > 2))


# Words that terms() leaves out.
TERM_STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "function", "class")


def terms(text: Column) -> Column:
    """T05. Distinct identifiers of three signs or more without stop words."""
    found = F.transform(_all(text, r"[A-Za-z_$][A-Za-z0-9_$]{2,}"), F.lower)
    return F.array_except(F.array_distinct(found), F.array(*(F.lit(x) for x in TERM_STOP_WORDS)))


def normalize_path(path: Column) -> Column:
    """T06. Forward slashes, no leading dots and slashes (all of them), no a/ or b/ in front."""
    clean = F.regexp_replace(F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/")), r"^[./]+", "")
    return F.regexp_replace(clean, "^[ab]/", "")


# Suffixes of languages.
LANGUAGES = {"typescript": (".ts", ".tsx", ".mts", ".cts"), "javascript": (".js", ".jsx", ".mjs", ".cjs"), "python": (".py",), "java": (".java",)}
# Suffixes of files that can be indexed, and stems of documents that are not.
CODE_SUFFIXES = (".c", ".cc", ".cfg", ".cjs", ".cpp", ".cs", ".css", ".go", ".h", ".hpp", ".html", ".ini", ".java", ".js", ".json", ".jsx", ".kt", ".kts", ".less", ".mjs", ".mts", ".php", ".py", ".rb", ".rs", ".scala", ".scss", ".svelte", ".swift", ".toml", ".ts", ".tsx", ".vue", ".yaml", ".yml")
DOC_STEMS = ("changelog", "code_of_conduct", "contributing", "license", "readme", "security")


def _ends(path: Column, suffixes: tuple[str, ...]) -> Column:
    return path.rlike("(" + "|".join(x.replace(".", r"\.") for x in suffixes) + ")$")


def language_of(path: Column) -> Column:
    """F07. Language by suffix, else empty."""
    out = F.lit("")
    for name, suffixes in LANGUAGES.items():
        out = F.when(_ends(F.lower(path), suffixes), name).otherwise(out)
    return out


def is_code_path(path: Column) -> Column:
    """F06. A code suffix, and neither a document's name nor its folder."""
    p = F.lower(normalize_path(path))
    stem = F.regexp_replace(F.regexp_extract(p, "[^/]*$", 0), r"\.[^.]*$", "")
    return _ends(p, CODE_SUFFIXES) & ~stem.isin(*DOC_STEMS) & ~F.contains(p, F.lit("issue_template")) & ~p.rlike("^(docs|doc|documentation)/")


def is_test_path(path: Column) -> Column:
    """F04. Some token between blanks, underscores and slashes starts with test."""
    return F.exists(F.split(F.lower(path), "[ _/]"), lambda x: F.startswith(x, F.lit("test")))


# Folders of tests.
TEST_FOLDERS = ("test", "tests", "__tests__", "spec", "specs", "__mocks__", "fixtures")


def in_test_folder(path: Column) -> Column:
    """F05. Some component is a test folder."""
    return F.arrays_overlap(F.split(F.lower(normalize_path(path)), "/"), F.array(*(F.lit(x) for x in TEST_FOLDERS)))


def glob_regex(pattern: str) -> str:
    """A glob in which * crosses slashes, as an anchored regular expression."""
    import re

    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and end > 0:
            out += "[" + ("^" if pattern[i + 1] == "!" else "") + pattern[i + 1 + (pattern[i + 1] == "!") : end].replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^(?s:{out})$"


def matches_path(path: Column, pattern: str) -> Column:
    """F08. A glob if the pattern has one of *?[, else a substring; /**/* also matches right below the folder."""
    if not any(c in pattern for c in "*?["):
        return F.contains(path, F.lit(pattern))
    found = path.rlike(glob_regex(pattern))
    return found | path.rlike(glob_regex(pattern.replace("/**/*", "/*"))) if "/**/*" in pattern else found


def extension(path: Column) -> Column:
    """T07. Suffix in lower case or <none>."""
    found = F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))
    return F.when(found == "", "<none>").otherwise(found)


def domain(url: Column) -> Column:
    """T07. Host with port and user as written, in lower case, or <unknown>."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(found == "", "<unknown>").otherwise(found)


IMAGE_URL = r"(?i)\.(png|jpe?g|gif|webp|svg|bmp)([?#].*)?$"


def urls(text: Column) -> Column:
    """T08. Sorted distinct http(s) addresses in a text."""
    return F.array_sort(F.array_distinct(_all(text, r"https?://[^\s\"'<>)\]]+")))


def string_list(value: Column) -> Column:
    """T09. Items of a JSON list without blank ones; anything else is one item, blank nothing."""
    text = F.trim(F.coalesce(value, F.lit("")))
    parsed = F.from_json(text, "array<string>")
    listed = F.filter(parsed, lambda x: F.trim(x) != "")
    return F.when(text == "", F.array().cast("array<string>")).when(text.startswith("[") & parsed.isNotNull(), listed).otherwise(F.array(text))


def symbols(text: Column, most: int = 200) -> Column:
    """R16. Paths, then quoted strings, then identifiers with a capital, underscore or dollar: the first distinct ones."""
    paths = _all(text, r"[A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)+\.[A-Za-z0-9]+")
    quoted = _all(text, r"[`'\"]([^`'\"\n]{3,120})[`'\"]", 1)
    names = F.filter(_all(text, r"[A-Za-z_$][A-Za-z0-9_$]*"), lambda t: t.rlike("[A-Z_$]"))
    found = F.transform(F.concat(paths, quoted, names), lambda x: F.trim(x))
    return F.slice(F.array_distinct(F.filter(found, lambda t: t != "")), 1, most)


def css_classes(text: Column) -> Column:
    """T17. Distinct names after a dot."""
    return F.array_distinct(_all(text, r"\.([a-zA-Z0-9_-]+)", 1))


def dom_classes(text: Column) -> Column:
    """T17. Distinct class names of class and className attributes and of querySelector('.x')."""
    attributes = F.flatten(F.transform(_all(text, r"class(?:Name)?\s*=\s*['\"]([^'\"]+)['\"]", 1), lambda v: F.split(F.trim(v), r"\s+")))
    selected = F.transform(_all(text, r"querySelector\(\s*['\"]\.([^'\"]+)['\"]\s*\)", 1), lambda x: F.trim(x))
    return F.array_distinct(F.filter(F.concat(attributes, selected), lambda t: t != ""))


def config_keys(text: Column) -> Column:
    """T17. Distinct names before a colon."""
    return F.array_distinct(_all(text, r"\b([a-zA-Z0-9_]+)\s*:", 1))


def import_lines(text: Column) -> Column:
    """T19. Lines that begin with import, or with from and hold import."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x.rlike(r"^import\s|^from\s+\S+\s+import\b"))


def squeeze(text: Column) -> Column:
    """T16. Single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def truncate(text: Column, most: int = 220) -> Column:
    """T16. At most so many signs, the last three being dots where some are left out."""
    t = squeeze(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("...")))


def line_windows(text: Column, size: int = 120, step: int = 100) -> Column:
    """T14. (start, end, chunk) of overlapping windows of lines, from 1; a last one may repeat the overlap only."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    n = F.size(lines)
    found = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda a: F.struct((a + 1).alias("start"), F.least(a + size, n).alias("end"), F.trim(F.concat_ws("\n", F.slice(lines, a + 1, F.lit(size)))).alias("chunk")))
    return F.filter(found, lambda c: c["chunk"] != "")


def fixed_chunks(text: Column, size: int) -> Column:
    """T15. (start, end, chunk) of consecutive groups of lines, from 1."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    n = F.size(lines)
    return F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda a: F.struct((a + 1).alias("start"), F.least(a + size, n).alias("end"), F.concat_ws("\n", F.slice(lines, a + 1, F.lit(size))).alias("chunk")))


def numbered(text: Column, start: int = 1) -> Column:
    """T13. Lines with right-justified numbers."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    width = F.length((F.size(lines) + start - 1).cast("string"))
    return F.concat_ws("\n", F.transform(lines, lambda x, i: F.concat(F.lpad((i + start).cast("string"), width, F.lit(" ")), F.lit(" | "), x)))


def normalize_answer(text: Column) -> Column:
    """M14. Lower case without punctuation and the words a, an, the, usd; single blanks."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return squeeze(F.regexp_replace(bare, r"\b(a|an|the|usd)\b", " "))


def entity_id(file: Column, qualified: Column) -> Column:
    """T10. file::name"""
    return F.concat(file, F.lit("::"), qualified)


def module_id(file: Column, qualified: Column) -> Column:
    """T10. file::parent, or the file for a top-level name."""
    return F.when(F.contains(qualified, F.lit(".")), F.concat(file, F.lit("::"), F.regexp_replace(qualified, r"\.[^.]*$", ""))).otherwise(file)


def confidence(score: Column) -> Column:
    """T28. high from 5, medium from 3, else low."""
    return F.when(score >= 5, "high").when(score >= 3, "medium").otherwise("low")


def weight(value: Column, default: float = 1.0) -> Column:
    """T28. A number not below 0, or the default."""
    return F.greatest(F.coalesce(F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double"), F.lit(default)), F.lit(0.0))


def repository_of(instance: Column) -> Column:
    """T24. owner/repo of owner__repo-123."""
    return F.replace(F.regexp_replace(instance, "-[^-]*$", ""), F.lit("__"), F.lit("/"))


def file_mentions(text: Column) -> Column:
    """T26. Distinct paths with a slash and a suffix in free text."""
    return F.array_distinct(_all(text, r"[A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)+\.[A-Za-z][A-Za-z0-9]*"))


def first_truthy(*columns: Column) -> Column:
    """F01. The first value that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in columns))


def evidence(*parts: Column) -> Column:
    """R17. The text of a query: its parts that are not null, line by line."""
    return F.concat_ws("\n", *parts)


def ordered_unique(items: Column) -> Column:
    """W03. Normalised distinct items in the order of their first places."""
    return F.array_distinct(F.filter(F.transform(items, normalize_path), lambda x: x != ""))


def redact_secrets(text: Column, secrets: list[str], mark: str = "<secret_hidden>") -> Column:
    """F23. Every secret replaced, longest first."""
    for secret in sorted(filter(None, secrets), key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(secret), F.lit(mark))
    return text
