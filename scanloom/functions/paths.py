"""Column functions for object names, URIs and locations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of files that are never image objects.
SKIP_EXTENSIONS = [
    "gz", "json", "md", "txt", "xml", "pdf", "py", "jpg", "jpeg", "png", "gif", "bmp", "webp", "svg", "ico",
    "tiff", "tif", "html", "htm", "css", "js", "mjs", "cjs", "zip", "zipx", "tar", "rar", "7z", "properties",
    "db", "csv",
]

# Common extensions and their registered media types.
MEDIA_TYPES: dict[str, str] = {
    "css": "text/css",
    "csv": "text/csv",
    "dcm": "application/dicom",
    "gif": "image/gif",
    "html": "text/html",
    "ico": "image/vnd.microsoft.icon",
    "jls": "image/jls",
    "jp2": "image/jp2",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "js": "text/javascript",
    "json": "application/json",
    "mjs": "text/javascript",
    "mp4": "video/mp4",
    "mpg": "video/mpeg",
    "pdf": "application/pdf",
    "png": "image/png",
    "svg": "image/svg+xml",
    "txt": "text/plain",
    "wasm": "application/wasm",
    "xml": "text/xml",
    "zip": "application/zip",
}

# Content type by name part, tried in this order after the media types.
NAME_PART_TYPES: list[tuple[str, str]] = [
    (".dcm", "application/dicom"),
    (".mht", "multipart/related"),
    ("bulkdata", "application/octet-stream"),
    (".raw", "application/octet-stream"),
    ("frames", "multipart/related"),
    ("thumbnail", "image/jpeg"),
    (".ion", "application/x-amzn-ion"),
    ("rendered", "image/png"),
]

# Fixed value: keys that must not be cached.
NO_CACHE = (
    r"(index.html)|(index.js)|(index.umd.js)|(studies$)|(theme/)|(^[a-zA-Z0-9\-_]+\.js)|(config/)"
)

# Fixed value: study / series / instance path of a rejection.
REJECT_PATH = (
    r"^(.*studies)?[\\/]?([0-9.a-zA-Z]+)[\\/](series[\\/])?([0-9.a-zA-Z]+)([\\/]instances[\\/]([0-9.a-zA-Z]*))?$"
)

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"


def scannable(path: Column) -> Column:
    """No path part is hidden or a resource-fork folder."""
    return ~path.rlike(r"(^|/)(__MACOSX|[.][^/]+)(/|$)")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/][.]([^./]+)$", 1))


def is_input_name(path: Column) -> Column:
    """Could be an image object, judged by its name."""
    return ~extension(path).isin(*SKIP_EXTENSIONS) & ~path.endswith("DICOMDIR")


def object_key(file: Column, prefix: str = "", index_name: str | None = None) -> Column:
    """Storage key of a file name; NULL when nothing is left of it."""
    name = F.replace(file, F.lit("\\"), F.lit("/"))
    if index_name:
        folder = index_name[: index_name.rfind("/") + 1]
        name = F.when(name == index_name, F.lit(f"{folder}index.json.gz")).otherwise(name)
    name = F.regexp_replace(name, r"[.](br|gz)$", "")
    name = F.when(name.startswith("/"), name).otherwise(F.concat(F.lit("/"), name))
    if prefix and prefix != "/":
        name = F.concat(F.lit(prefix), name)
    name = F.regexp_replace(name, r"/index[.](json|mht)$", "")
    name = F.regexp_replace(name, r"^/", "")
    name = F.when(name.contains(".mht"), F.regexp_replace(name, r"(?s)^(.+)[.]mht.*$", "$1")).otherwise(
        F.regexp_replace(name, r"(?s)^(.+)[.]jhc.*$", "$1")
    )
    return F.nullif(name, F.lit(""))


def key_to_file(key: Column, prefix: str = "") -> Column:
    """File name of a storage key."""
    path = F.substr(key, F.lit(len(prefix) + 1)) if prefix else key
    folder = path.endswith("/series") | path.endswith("/studies") | path.endswith("/instances")
    return (
        F.when(path.endswith("thumbnail"), path)
        .when(path.endswith("/"), F.concat(path, F.lit("index.json.gz")))
        .when(folder, F.concat(path, F.lit("/index.json.gz")))
        .when(path.endswith(".gz") | path.endswith(".jls"), path)
        .otherwise(F.concat(path, F.lit(".gz")))
    )


def content_type(file: Column, media_types: Mapping[str, str] = MEDIA_TYPES) -> Column:
    src = F.regexp_replace(file, r"[.](br|gz)$", "")
    known = F.create_map(*[F.lit(x) for pair in media_types.items() for x in pair])
    by_extension = known[F.lower(F.regexp_extract(src, r"[.]([^./\\]+)$", 1))]
    by_part = reduce(
        lambda acc, p: acc.when(src.contains(p[0]), p[1]),
        NAME_PART_TYPES[1:],
        F.when(src.contains(NAME_PART_TYPES[0][0]), NAME_PART_TYPES[0][1]),
    )
    return F.coalesce(by_extension, by_part.otherwise("application/json"))


def content_encoding(file: Column) -> Column:
    return F.when(file.contains(".br"), "brotli").when(file.contains(".gz"), "gzip")


def cache_control(key: Column) -> Column:
    return F.when(key.rlike(NO_CACHE), "no-cache")


def hashed_study_folder(study: Column) -> Column:
    """Study folder below two fan-out levels of a stable hash."""
    digest = F.sha2(study, 256)
    return F.concat_ws("/", F.substring(digest, 1, 3), F.substring(digest, 4, 3), study)


def archive_path(
    study: Column, series: Column | None = None, sop: Column | None = None, frame: Column | None = None,
    hashed: bool = False,
) -> Column:
    """``studies/<uid>[/series/<uid>[/instances/<uid>[/frames/<n>]]]``."""
    parts = [F.lit("studies"), hashed_study_folder(study) if hashed else study]
    for label, value in (("series", series), ("instances", sop), ("frames", frame)):
        if value is not None:
            parts += [F.lit(label), value.cast("string")]
    return F.concat_ws("/", *parts)


def bulk_path(digest: Column, layout: tuple[int, int] = (2, 2), suffix: str = ".mht.gz") -> Column:
    """Content-addressed path ``aa/bb/rest``; layout (3, 2) is the older one."""
    a, b = layout
    return F.concat(
        F.substring(digest, 1, a), F.lit("/"), F.substring(digest, a + 1, b), F.lit("/"),
        F.substr(digest, F.lit(a + b + 1)), F.lit(suffix),
    )


def rewrite_bulk_uri(uri: Column, sop: Column) -> Column:
    """Instance-relative URI to series-relative."""
    return F.when(uri.startswith("./frames"), F.concat(F.lit("./instances/"), sop, F.lit("/frames"))).otherwise(
        F.regexp_replace(uri, r"^([.][.]/){4}bulkdata/", "../../bulkdata/")
    )


def rewrite_bulk_uris(document: Column, sop: Column) -> Column:
    """The same over a JSON document, at any nesting depth.

    Works on the serialised text: a ``BulkDataURI`` member is recognised by its name,
    and inside a JSON string the quotes around it would be escaped.
    """
    framed = F.regexp_replace(
        document,
        F.lit(r'(?<!\\)("BulkDataURI"\s*:\s*")[.]/frames[^"]*"'),
        F.concat(F.lit("$1./instances/"), sop, F.lit('/frames"')),
    )
    return F.regexp_replace(
        framed, r'(?<!\\)("BulkDataURI"\s*:\s*")(?:[.][.]/){4}bulkdata/', "$1../../bulkdata/"
    )


def expand_uri(
    path: Column, study: Column, series: Column, prepend: str = "", expand: bool = True, include_series: bool = False
) -> Column:
    """Prepend a host and, when expanding, the study (and series) folder."""
    parts = [F.lit(prepend)]
    if expand:
        parts += [F.lit("studies/"), study, F.lit("/")]
        if include_series:
            parts += [F.lit("series/"), series, F.lit("/")]
    return F.concat(*parts, path)


def retrieve_url(
    study: Column, root: Column, template: str = "/api/studies/{studyInstanceUID}"
) -> Column:
    """Root without trailing slashes + path template; NULL without a study."""
    base = F.regexp_replace(F.coalesce(root, F.lit("")), r"/+$", "")
    path = F.replace(F.lit(template), F.lit("{studyInstanceUID}"), study)
    glued = F.concat(base, F.when(path.startswith("/"), "").otherwise("/"), path)
    return F.when(F.coalesce(study, F.lit("")) != "", F.when(base == "", path).otherwise(glued))


def join_uri(*parts: Column) -> Column:
    """Parts joined with exactly one slash, empty parts left out."""

    def glue(left: Column, right: Column) -> Column:
        l, r = left.endswith("/"), right.startswith("/")
        return (
            F.when(F.coalesce(left, F.lit("")) == "", F.coalesce(right, F.lit("")))
            .when(F.coalesce(right, F.lit("")) == "", left)
            .when(~l & ~r, F.concat(left, F.lit("/"), right))
            .when(l & r, F.concat(left, F.substr(right, F.lit(2))))
            .otherwise(F.concat(left, right))
        )

    return F.coalesce(reduce(glue, parts), F.lit(""))


def parse_reject_path(path: Column) -> Column:
    """Study, series and optional instance of a rejection path; all NULL if it is none."""
    hit = path.rlike(REJECT_PATH)

    def part(i: int) -> Column:
        return F.when(hit, F.nullif(F.regexp_extract(path, REJECT_PATH, i), F.lit("")))

    return F.struct(part(2).alias("study_uid"), part(4).alias("series_uid"), part(6).alias("sop_uid"))


def location_kind(location: Column) -> Column:
    """``file`` or ``remote`` plus the file path."""
    s = F.trim(location)
    scheme = F.lower(F.regexp_extract(s, SCHEME, 1))
    drive = s.rlike(r"^[a-zA-Z]:[/\\]")
    blank = F.coalesce(s, F.lit("")) == ""
    is_file = ~blank & ((scheme == "") | (scheme == "file") | drive)
    encoded = F.replace(F.regexp_replace(s, r"^[fF][iI][lL][eE]:(//)?", ""), F.lit("+"), F.lit("%2B"))
    bare = F.coalesce(F.try_url_decode(encoded), s)
    path = F.when(is_file, F.when(scheme == "file", bare).otherwise(s))
    return F.struct(F.when(is_file, "file").otherwise("remote").alias("kind"), path.alias("path"))


def include_exclude(name: Column, include: Sequence[str] = (), exclude: Sequence[str] = ("temp",)) -> Column:
    """Some include text occurs (or none is given) and no exclude text does."""
    keep = F.lit(True)
    if include:
        keep = reduce(lambda a, b: a | b, [name.contains(i) for i in include])
    if exclude:
        keep = keep & ~reduce(lambda a, b: a | b, [name.contains(e) for e in exclude])
    return keep


def name_in(name: Column, names: Sequence[str] | None) -> Column:
    """Listed names only; an empty list lets everything pass."""
    return name.isin(*names) if names else F.lit(True)
