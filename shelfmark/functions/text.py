"""Column functions on names, paths, addresses and tags. All are built-in expressions; null gives null."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_key(name: Column) -> Column:
    """Letters and digits of a name, lower-cased, without one trailing copy mark such as `` (2)`` or `` copy 3``."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"\s*(\(\d+\)|copy( of| \d+)?)$", "")
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def display_name(name: Column, fallback: str = "Unnamed", longest: int = 100) -> Column:
    """A name fit for a folder: no ``Copy of`` or time stamp, no characters that file systems reject, one blank at a time."""
    bare = F.regexp_replace(name, r"^(?i:copy of )+", "")
    bare = F.regexp_replace(bare, r"[_-]\d{8}([_-]\d{6})?$", "")
    bare = F.regexp_replace(bare, r'[<>:"/\\|?*]', " ")
    bare = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.coalesce(F.nullif(F.substring(bare, 1, longest), F.lit("")), F.lit(fallback))


def without_copy_prefix(name: Column) -> Column:
    return F.regexp_replace(name, r"^(?i:copy of\s+)+", "")


def copy_number(name: Column) -> Column:
    """The number of a trailing `` (n)``, else null."""
    return F.regexp_extract(name, r"\((\d+)\)\s*$", 1).try_cast("int")


def is_copy_name(name: Column) -> Column:
    return name.rlike(r"(?i)(^copy of\s|\(\d+\)\s*$|\scopy(\s\d+)?$)")


def original_name(filename: Column) -> Column:
    """A file's name without the marks of a copy: a leading ``Copy of``, a trailing `` (n)`` or `` copy n`` of the stem."""
    stem, ending = F.regexp_replace(filename, r"\.[^.]*$", ""), F.regexp_extract(filename, r"(\.[^.]*)$", 1)
    return F.concat(F.regexp_replace(without_copy_prefix(stem), r"(?i)\s*\(\d+\)\s*$|\scopy(\s\d+)?$", ""), ending)


def dashed(name: Column) -> Column:
    """Lower case, with one dash for each run of other characters and none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def title(name: Column) -> Column:
    """Underscores and dashes as blanks, and each word's first letter in upper case; the rest as it is."""
    words = F.split(F.regexp_replace(name, "[_-]", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def trim_slashes(path: Column) -> Column:
    """Without one leading and one trailing slash."""
    return F.regexp_replace(F.regexp_replace(path, "^/", ""), "/$", "")


def parent(path: Column) -> Column:
    """The folder of a path; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """All proper ancestors of a path, the nearest last: a/b/c has a and a/b."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))


def extension(filename: Column) -> Column:
    """Lower-cased, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))


def folder_tags(path: Column, stop_words: list[str] = ()) -> Column:
    """Words of the last folder's name that are longer than one letter and no stop words."""
    words = F.split(F.lower(F.element_at(F.split(path, "/"), -1)), r"[\s_-]+")
    kept = F.filter(words, lambda w: F.length(w) > 1)
    return F.array_except(kept, F.array(*map(F.lit, stop_words)).cast("array<string>")) if stop_words else F.array_distinct(kept)


def has_keyword(path: Column, keywords: list[str]) -> Column:
    """Whether some word of the path, cut at punctuation and blanks, is a keyword."""
    return F.arrays_overlap(F.split(F.lower(path), r"[\s/._()\[\]-]+"), F.array(*map(F.lit, keywords)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def site(url: Column) -> Column:
    """The second-level label of the host; a host without dots stays."""
    labels = F.split(host(url), r"\.")
    return F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(F.element_at(labels, -1))


def renamed(filename: Column, pattern: str, replacement: str) -> Column:
    """The name with a pattern replaced in what stands before the ending, which stays."""
    stem, ending = F.regexp_replace(filename, r"\.[^.]*$", ""), F.regexp_extract(filename, r"(\.[^.]*)$", 1)
    return F.concat(F.regexp_replace(stem, pattern, replacement), ending)


def relative_path(path: Column, base: Column) -> Column:
    """path as seen from the folder base, with ``..`` for each step up; ``.`` for base itself."""
    p, b = F.split(path, "/"), F.split(base, "/")
    at = F.sequence(F.lit(1), F.greatest(F.least(F.size(p), F.size(b)), F.lit(1)))
    same = F.size(F.filter(at, lambda n: F.slice(p, 1, n) == F.slice(b, 1, n)))
    parts = F.concat(F.array_repeat(F.lit(".."), F.size(b) - same), F.slice(p, same + 1, F.greatest(F.size(p) - same, F.lit(0))))
    return F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/"))


def merge_prefix(target: Column, source: Column, same_library: Column) -> Column:
    """Where a merged item's files go under the target: the relative path if both share a root, else the source folder's name."""
    shared = same_library & (F.split(target, "/")[0] == F.split(source, "/")[0])
    return F.when(shared, relative_path(source, target)).otherwise(F.element_at(F.split(source, "/"), -1))


def format_note(extension: Column, head: Column) -> Column:
    """Why a mesh format is inefficient, from its extension and its first bytes as text; null if it is not."""
    ascii_ply = head.startswith("ply\rformat ascii")
    return F.when((extension == "stl") & head.startswith("solid "), "ASCII STL").when(extension == "obj", "Wavefront OBJ").when((extension == "ply") & ascii_ply, "ASCII PLY")


#: The two forms of a download site's readme.
README_SHORT = r"(.*) by (.*) on Thingiverse: (https?://www\.thingiverse\.com/thing:[0-9]+)"
README_LONG = r"(https?://www\.thingiverse\.com/thing:[0-9]+)\n(.*) by (.*) is licensed under the (.*) license\.\n(https?://.*)\n\n# Summary\n\n(.*)"


def readme_fields(text: Column) -> Column:
    """A struct (name, creator, url, license_url, notes) of a readme; one of another form is all notes."""
    plain = F.regexp_replace(text, r"(?i)\{(.+?) %!S\(Bool=True\)\}", "$1")
    short, long = text.rlike(README_SHORT), text.rlike(README_LONG)
    by_short, by_long = (lambda k: F.regexp_extract(plain, README_SHORT, k)), (lambda k: F.regexp_extract(plain, README_LONG, k))
    pick = lambda s, g: F.when(short, by_short(s)).when(long, by_long(g))
    return F.struct(
        pick(1, 2).alias("name"), pick(2, 3).alias("creator"), pick(3, 1).alias("url"), F.when(~short & long, by_long(5)).alias("license_url"),
        F.when(short, F.lit(None).cast("string")).when(long, by_long(6)).otherwise(text).alias("notes"),
    )


def license_of_url(df: DataFrame, url: str, known: DataFrame, out: str = "license") -> DataFrame:
    """df with the identifier of the licence with that address, http or https, and ``legalcode`` left out of known ones.

    known has license and url; of more licences at one address the first name counts.
    """
    names = known.groupBy(F.regexp_replace("url", "legalcode", "").alias("_at")).agg(F.min("license").alias(out))
    return df.join(names, F.regexp_replace(F.col(url), "^http:", "https:") == F.col("_at"), "left").drop("_at")


def guessed_category(name: Column, rules: list[tuple[str, str]], default: str = "Unknown") -> Column:
    """The category of the first pattern that the name matches, whatever its case."""
    out = None
    for pattern, category in rules:
        out = (F if out is None else out).when(name.rlike(f"(?i){pattern}"), category)
    return F.lit(default) if out is None else out.otherwise(default)


def leading_components(paths: Column) -> Column:
    """At how many positions all of an array of paths hold the same part."""
    parts = F.transform(paths, lambda p: F.split(p, "/"))
    least = F.array_min(F.transform(parts, lambda p: F.size(p)))
    at = F.sequence(F.lit(1), F.greatest(least, F.lit(1)))
    return F.size(F.filter(at, lambda n: F.size(F.array_distinct(F.transform(parts, lambda p: F.slice(p, n, 1)))) == 1))


def server_and_port(url: Column) -> Column:
    """Host, with the port unless it is 80 or 443."""
    port = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#:]+:(\d+)", 1)
    return F.when(port.isin("", "80", "443"), host(url)).otherwise(F.concat(host(url), F.lit(":"), port))


def masked_email(address: Column) -> Column:
    """First letter and last label of the domain; stars between."""
    return F.regexp_replace(address, r"^(.)[^@]*@.*(\.[^.]+)$", "$1***@***$2")


def subject_kind(token: Column) -> Column:
    """``role``, ``public``, ``group`` or ``user``, by the form of a subject token."""
    return F.when(token == "role::public", "public").when(token.startswith("role::"), "role").when(token.startswith("group::"), "group").otherwise("user")


def safe_entry(path: Column) -> Column:
    """An archive entry's path with plain separators, or null if it is absolute, has a drive or climbs."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", "")
    bad = plain.rlike(r"^/|^[a-zA-Z]:|(^|/)\.\.?(/|$)") | (plain == "")
    return F.when(~bad, plain)


def recovered_json(text: Column) -> Column:
    """The outermost braces of a text that may carry fences or prose around a JSON object; null if there are none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def mapped(value: Column, names: dict[str, str], default: str) -> Column:
    """The entry of a small fixed map for the lower-cased, trimmed value."""
    pairs = [F.lit(x) for k, v in names.items() for x in (k.lower(), v)]
    return F.coalesce(F.create_map(*pairs)[F.lower(F.trim(value))], F.lit(default))


#: The letters of public ids, without vowels.
PUBLIC_ALPHABET = "0123456789bcdfghjklmnpqrstvwxyz"


def public_id(key: Column, length: int = 12) -> Column:
    """A short id without vowels, drawn from a digest of the key: stable, and equal keys have equal ids."""
    digest, n = F.sha2(key.cast("string"), 256), len(PUBLIC_ALPHABET)
    letters = [F.substr(F.lit(PUBLIC_ALPHABET), (F.conv(F.substring(digest, 1 + 4 * k, 4), 16, 10).cast("int") % n) + 1, F.lit(1)) for k in range(length)]
    return F.concat(*letters)


@dataclass(frozen=True)
class PathTemplate:
    """A library's path template, such as ``{creator}/{collection}/{model_name}``, as a regular expression."""

    template: str

    #: The fields of a template and what they match.
    FIELDS = {"creator": "([^/]+)", "collection": "([^/]+)", "model_name": "([^/]+?)", "tags": "(.+)"}

    def pattern(self) -> tuple[str, list[str]]:
        """(expression, fields in the order of its groups)."""
        names: list[str] = []

        def part(m: re.Match) -> str:
            if m[1] not in self.FIELDS:
                return re.escape(m[0])
            names.append(m[1])
            return self.FIELDS[m[1]]

        pieces = re.split(r"(\{\w+\})", self.template)
        body = "".join(part(m) if (m := re.fullmatch(r"\{(\w+)\}", p)) else re.escape(p) for p in pieces)
        return f"^/?(?:.*/)?{body}(?:#\\d+)?/?$", names

    def parse(self, path: Column) -> dict[str, Column]:
        """A column for each field; null where the path does not match. Tags are an array."""
        expression, names = self.pattern()
        fields = {n: F.when(path.rlike(expression), F.regexp_extract(path, expression, k + 1)) for k, n in enumerate(names)}
        return fields | ({"tags": F.split(fields["tags"], "/")} if "tags" in fields else {})

    def format(self, creator: Column, collection: Column, model_name: Column, tags: Column, number: Column) -> Column:
        """The path of an item, with place holders for what it lacks, and its number at the end."""
        values = {
            "creator": F.coalesce(dashed(creator), F.lit("@unattributed")),
            "collection": F.coalesce(dashed(collection), F.lit("@uncollected")),
            "model_name": dashed(model_name),
            "tags": F.when(F.size(tags) > 0, F.array_join(tags, "/")).otherwise("@untagged"),
        }
        pieces = re.split(r"(\{\w+\})", self.template)
        return F.concat(*[values.get(p[1:-1], F.lit(p)) if p.startswith("{") else F.lit(p) for p in pieces if p], F.lit("#"), number.cast("string"))
