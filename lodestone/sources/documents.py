"""Sources of documents: file signatures, names, archives, Markdown in and out. Everything is a Column or a plain reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes of file formats by extension, and of pictures.
MAGIC = {
    "pdf": b"%PDF", "docx": b"PK\x03\x04", "docm": b"PK\x03\x04", "pptx": b"PK\x03\x04", "xlsx": b"PK\x03\x04", "doc": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1",
    "xls": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "gif": b"GIF8",
}
IMAGE_MAGIC = {b"BM": "bmp", b"\x89PNG": "png", b"\xff\xd8": "jpg", b"GIF8": "gif"}


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length and content of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of Markdown files; bytes that aren't UTF-8 are read as cp1251."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(_cp1251(F.col("content")))
    return raw.select("path", text.alias("text"))


def _cp1251(content: Column) -> Column:
    """Bytes read as cp1251: as Latin-1 first, then the upper half of the table exchanged."""
    upper = range(0x80, 0x100)
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, upper)), "".join(bytes([b]).decode("cp1251", "replace") for b in upper))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Lines of JSON under a schema; a bad line stays in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def first_non_empty(candidates: list[DataFrame]) -> DataFrame | None:
    """The first candidate that has a row."""
    return next((c for c in candidates if not c.isEmpty()), None)


def signature(content: Column | str, extension: Column | str) -> Column:
    """Kind of a file by its first bytes: match, image, html or unknown, in this order."""
    c = F.col(content) if isinstance(content, str) else content
    x = F.col(extension) if isinstance(extension, str) else extension
    head = F.hex(F.substring(c, 1, 16))
    want = F.try_element_at(F.create_map(*[F.lit(v) for k, m in MAGIC.items() for v in (k, m.hex().upper())]), F.lower(x))
    image = F.lit(False)
    for m in IMAGE_MAGIC:
        image = image | head.startswith(m.hex().upper())
    html = F.lower(F.decode(F.substring(c, 1, 64), "ISO-8859-1")).rlike(r"^\s*(<!doctype|<html|<\?xml)")
    return F.when(head.startswith(want), "match").when(image, "image").when(html, "html").otherwise("unknown")


def safe_path(name: Column | str) -> Column:
    """A path component without reserved characters, trailing dots and blanks; '_' if nothing is left."""
    c = F.regexp_replace(F.regexp_replace(F.col(name) if isinstance(name, str) else name, r'[<>:"\\|?*]', "_"), r"[. ]+$", "")
    return F.when(c == "", "_").otherwise(c)


def archive_sets(files: DataFrame, path: str) -> DataFrame:
    """Archives with their volumes grouped: (folder, base, kind, volumes, entry); the lowest volume is the entry."""
    p = F.col(path)
    name = F.regexp_extract(p, r"([^/]+)$", 1)
    rar = F.regexp_extract(name, r"(?i)^(.*)\.part(\d+)\.rar$", 2)
    num = F.regexp_extract(name, r"(?i)^(.*)\.(?:zip|rar|7z)\.(\d{3})$", 2)
    base = (
        F.when(rar != "", F.regexp_extract(name, r"(?i)^(.*)\.part(\d+)\.rar$", 1)).when(num != "", F.regexp_extract(name, r"(?i)^(.*)\.(?:zip|rar|7z)\.(\d{3})$", 1))
        .when(name.rlike(r"(?i)\.(zip|rar|7z)$"), F.regexp_replace(name, r"(?i)\.(zip|rar|7z)$", ""))
    )
    volume = F.coalesce(F.nullif(rar, F.lit("")), F.nullif(num, F.lit("")), F.lit("1")).cast("int")
    rows = files.select(F.regexp_extract(p, r"^(.*)/", 1).alias("folder"), base.alias("base"), volume.alias("volume"), p.alias("path")).where("base is not null")
    return rows.groupBy("folder", "base").agg(F.count("*").alias("volumes"), F.min_by("path", F.struct("volume", "path")).alias("entry"))


def to_download(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote files that aren't there in the same size: (path, size)."""
    return remote.join(local, ["path", "size"], "left_anti")


def relocations(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, target) for files whose name fits exactly one wanted path, or exactly one of the same size."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    have = files.select("path", "size", name.alias("name"))
    want = wanted.select(F.col("path").alias("target"), F.col("size").alias("want_size"), name.alias("name"))
    pairs = have.join(want, "name")
    counts = pairs.groupBy("path").agg(
        F.count("*").alias("n"), F.count_if(F.col("size") == F.col("want_size")).alias("n_same"), F.min("target").alias("only"),
        F.min(F.when(F.col("size") == F.col("want_size"), F.col("target"))).alias("same"),
    )
    target = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_same") == 1, F.col("same"))
    return counts.select("path", target.alias("target"), target.isNull().alias("ambiguous"))


def block_markdown(kind: str, content: str, level: str, rows: str, image: str, caption: str) -> Column:
    """Markdown of one parsed block."""
    cells = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    r = F.col(rows)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(r[0], lambda c: F.lit("---")), " | "), F.lit(" |"))
    table = F.when(F.size(r) > 0, F.concat_ws("\n", cells(r[0]), rule, F.array_join(F.transform(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), cells), "\n")))
    head = F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce(level, F.lit(1)), F.lit(1)), F.lit(6))), F.lit(" "), F.trim(content))
    pic = F.concat(F.lit("["), F.coalesce(image, F.lit("IMAGE")), F.lit("]"), F.coalesce(F.concat(F.lit(" "), F.nullif(F.trim(caption), F.lit(""))), F.lit("")))
    k = F.col(kind)
    return F.when(k == "heading", head).when(k == "table", F.rtrim(table, F.lit("\n"))).when(k == "image", pic).otherwise(F.trim(content))


def front_matter(text: Column | str) -> tuple[Column, Column]:
    """(number of characters before the body, map of the keys) of a text; 0 and an empty map without front matter.

    Of a repeated key the last value counts.
    """
    c = F.col(text) if isinstance(text, str) else text
    close = F.locate("\n---\n", c, 4)
    size = F.when(c.startswith("---\n---\n"), 8).when(c.startswith("---\n") & (close > 0), close + 4).otherwise(0)
    lines = F.filter(F.split(F.left(c, size), "\n"), lambda x: x.contains(":") & (F.trim(x) != "---"))
    keys = F.transform(lines, lambda x: F.trim(F.substring_index(x, ":", 1)))
    values = F.transform(lines, lambda x: F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))))
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"]))
    return size, F.map_from_entries(pairs)


def cell_text(value: Column, kind: Column) -> Column:
    """A spreadsheet cell as text: whole numbers without decimals, dates in ISO form, booleans in capitals, errors marked."""
    number = value.try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(value)
    return (
        F.when(kind == "number", whole).when(kind == "boolean", F.when(value.isin("1", "true", "TRUE"), "TRUE").otherwise("FALSE"))
        .when(kind == "error", F.concat(F.lit("#ERR:"), value)).when(kind == "date", F.date_format(value.try_cast("timestamp"), "yyyy-MM-dd"))
        .when(kind == "empty", "").otherwise(F.trim(value))
    )
