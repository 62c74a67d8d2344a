"""Which files of a folder are read, and as what: walk, containment, admission, language, module names.

Every file found becomes a row of `artifacts`, also the ones that are not read; its status and reason say why.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.ids import content_id

# Limits, languages by suffix, what is analysed, what is passed over.
MAX_FILE_BYTES = 8 * 1024 * 1024
NUL_SCAN_BYTES = 8192
LANGUAGES = {".py": "python", ".js": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".kt": "kotlin", ".swift": "swift", ".scala": "scala", ".sh": "shell", ".sql": "sql", ".md": "markdown", ".json": "json", ".xml": "xml", ".csv": "csv", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".html": "html", ".pdf": "pdf", ".docx": "docx"}
CONTAINERS = (".pdf", ".docx")
ANALYSED = (".py", ".pdf", ".docx")
MEDIA_TYPES = {".py": "text/x-python", ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
IGNORED_FOLDERS = (".git", "__pycache__", ".venv", "venv", "node_modules", ".mypy_cache")
IGNORED_SUFFIXES = (".pyc", ".pyo", ".so", ".dylib", ".dll", ".o", ".a", ".zip", ".gz", ".tar", ".whl", ".png", ".jpg", ".db", ".sqlite", ".lbug", ".wal", ".shm")


def canonical(path: str) -> str:
    """A relative path with forward slashes and without empty, `.` and leading parts; parts `..` stay, so that they can be
    refused."""
    return "/".join(p for p in path.replace("\\", "/").split("/") if p not in ("", "."))


def contained(root: str | Path, candidate: str | Path) -> Path:
    """The real path of a candidate, which must lie in the root; ValueError for what escapes it (`..`, another root, a
    symbolic link that leads out)."""
    top, real = os.path.realpath(root, strict=True), os.path.realpath(os.path.join(root, candidate))
    if os.path.commonpath([top, real]) != top:
        raise ValueError(f"path escapes root: {candidate}")
    return Path(real)


def suffix(path: Column) -> Column:
    """The lower-cased suffix of a path's last part with its dot, '' if it has none; a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/]((?:\.[^./]+))$", 1))


def walked(rel_path: Column) -> Column:
    """Whether a walk comes to a file: no ignored or hidden folder above it, no ignored suffix."""
    folders = F.slice(F.split(rel_path, "/"), F.lit(1), F.size(F.split(rel_path, "/")) - 1)
    passed = F.exists(folders, lambda f: f.isin(*IGNORED_FOLDERS) | f.startswith("."))
    return ~passed & ~suffix(rel_path).isin(*IGNORED_SUFFIXES)


def language(path: Column) -> Column:
    """The language that a suffix stands for, null if it is unknown."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), suffix(path))


def rejection(path: Column, content: Column) -> Column:
    """The code of the first rule that a file breaks, null if it is admitted. Containers of documents are not text."""
    head = F.substring(content, 1, NUL_SCAN_BYTES).cast("binary")
    text = ~suffix(path).isin(*CONTAINERS)
    outside = path.startswith("/") | F.exists(F.split(path, "/"), lambda p: p == "..")
    nul = F.contains(F.hex(head), F.lit("00")) & F.contains(F.decode(head, "ISO-8859-1"), F.lit("\0"))
    return F.when(outside, "PATH_UNSAFE").when(content.isNull(), "NOT_A_FILE").when(F.octet_length(content) > MAX_FILE_BYTES, "OVERSIZE").when(text & nul, "BINARY_AS_TEXT").when(text & ~F.is_valid_utf8(content), "UNDECODABLE")


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, content) of the files below a folder that a walk comes to. Below a local folder symbolic links are told:
    links to folders are not followed, and files that lead out of the root keep null content and a path that is refused."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = root.rstrip("/") if "://" in root else Path(root).resolve().as_posix()
    rel = F.substring_index(F.col("path"), f"{top}/", -1)
    files = found.select(rel.alias("rel_path"), "content")
    # The reader passes over files without a byte, but an empty file is an artifact, and may make a package.
    if empty := _empty(spark, root):
        files = files.unionByName(spark.createDataFrame([(p, bytearray()) for p in empty], "rel_path string, content binary"))
    files = files.where(walked(F.col("rel_path")))
    if "://" not in root:
        linked, escaping = _links(Path(root))
        for folder in linked:
            files = files.where(~F.col("rel_path").startswith(f"{folder}/"))
        if escaping:
            out = F.col("rel_path").isin(*escaping)
            files = files.select(F.when(out, F.concat(F.lit("../"), "rel_path")).otherwise(F.col("rel_path")).alias("rel_path"), F.when(~out, F.col("content")).alias("content"))
    return files


def _empty(spark: SparkSession, root: str) -> list[str]:
    """Paths below a folder of files without a byte; a listing of names and sizes, as the reader makes one."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix, found, names = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/", fs.listFiles(top, True), []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0:
            names.append(status.getPath().toUri().getPath().removeprefix(prefix))
    return names


def _links(root: Path) -> tuple[list[str], list[str]]:
    """Linked folders, and linked files that lead out of the root; a listing of names only."""
    folders, files = [], []
    for at, below, names in os.walk(root, followlinks=False):
        folders += [Path(at, d).relative_to(root).as_posix() for d in below if Path(at, d).is_symlink()]
        for f in names:
            if Path(at, f).is_symlink():
                try:
                    contained(root, Path(at, f).relative_to(root))
                except ValueError:
                    files.append(Path(at, f).relative_to(root).as_posix())
    return folders, files


def artifacts(files: DataFrame, uri: str) -> DataFrame:
    """(artifact_id, source_id, rel_path, sha256, size_bytes, media_type, language, status, reason, content) of files
    (rel_path, content). status is null for files that are yet to be parsed; a file that is not keeps no content."""
    path, content = F.col("rel_path"), F.col("content")
    why, end, lang = rejection(path, content), suffix(path), F.coalesce(language(path), F.lit("unknown"))
    unsupported = ~end.isin(*ANALYSED)
    rows = files.select("rel_path", "content", F.lit(None if uri is None else uri).alias("uri"), unsupported.alias("unsupported"), why.alias("why"), lang.alias("language"), end.alias("end"))
    read = ~F.col("unsupported") & F.col("why").isNull()
    sha = F.when(read, F.sha2("content", 256))
    source = content_id("source", F.col("uri"))
    named = F.when(F.col("unsupported"), F.concat(F.lit("unsupported:"), "language")).when(F.col("why").isNotNull(), F.concat(F.lit("rejected:"), "why")).otherwise(sha)
    size = F.when(F.col("unsupported") | read, F.octet_length("content")).otherwise(0).cast("long")
    return rows.select(
        content_id("artifact", source, path, named).alias("artifact_id"), source.alias("source_id"), "rel_path", F.coalesce(sha, F.lit("")).alias("sha256"), size.alias("size_bytes"),
        F.when(read, F.element_at(F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair)), F.col("end"))).otherwise("application/octet-stream").alias("media_type"), "language",
        F.when(F.col("unsupported"), "UNSUPPORTED").when(F.col("why").isNotNull(), "SKIPPED").alias("status"),
        F.when(F.col("unsupported"), F.concat(F.lit("no analyser for language '"), "language", F.lit("'"))).otherwise(F.col("why")).alias("reason"),
        F.when(read, F.col("content")).alias("content"),
    )


def module_names(files: DataFrame) -> DataFrame:
    """(rel_path, module) of the rows of (rel_path): dotted from the outermost folder above the file that is a package;
    without one, from the top if the file lies at the top or its first folder is a package, else the file's own name."""
    parts = F.filter(F.split(F.regexp_replace("rel_path", r"\.py$", ""), "/"), lambda p: ~p.isin("", "."))
    named = F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    rows = files.select("rel_path", named.alias("parts")).distinct()
    packages = files.where(F.col("rel_path").endswith("/__init__.py")).select(F.regexp_replace("rel_path", "/__init__.py$", "").alias("folder")).distinct().withColumn("package", F.lit(True))
    # The file's folders by depth, those that hold an __init__.py marked; the least deep one is where the name begins.
    above = rows.where(F.size("parts") > 1).select("rel_path", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("depth"))
    above = above.withColumn("folder", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/")).join(packages, "folder", "left")
    first = above.where("package").groupBy("rel_path").agg(F.min("depth").alias("depth"))
    begins = F.coalesce(F.col("depth"), F.size("parts"))
    name = F.when(F.size("parts") == 0, "__root__").when(F.size("parts") == 1, F.element_at("parts", 1)).otherwise(F.array_join(F.slice("parts", begins, F.size("parts")), "."))
    return rows.join(first, "rel_path", "left").select("rel_path", F.when(F.size("parts") == 0, "__root__").otherwise(name).alias("module"))
