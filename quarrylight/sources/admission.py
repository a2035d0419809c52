"""Which files may enter: path safety, secrets, binaries, languages, import rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

#: Languages by suffix, lock files by name.
LANGUAGES = {
    "css": "css", "htm": "html", "html": "html", "java": "java", "js": "javascript", "json": "json", "jsonc": "jsonc", "jsx": "javascript", "md": "markdown", "mdx": "markdown", "mjs": "javascript",
    "py": "python", "pyi": "python", "sh": "shell", "sql": "sql", "toml": "toml", "ts": "typescript", "tsx": "tsx", "txt": "text", "yaml": "yaml", "yml": "yaml",
}
LOCK_FILES = ("cargo.lock", "composer.lock", "package-lock.json", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock")
#: Shapes that mark a file as holding a secret.
SECRETS = (r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", r"\bAKIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{30,}\b", r"\bxox[baprs]-[A-Za-z0-9-]{20,}\b")
SECRET_BYTES = 256_000
#: Fixed values of the import rules.
DOCUMENT_SUFFIXES = ("docx", "htm", "html", "markdown", "md", "pdf", "pptx", "rst", "srt", "text", "txt", "vtt", "xlsx")
SKIPPED_DIRECTORIES = (".cache", ".git", ".hg", ".next", ".nox", ".svn", ".tox", ".venv", "__pycache__", "build", "coverage", "dist", "env", "exports", "htmlcov", "node_modules", "out", "site-packages", "target", "vendor", "venv")
ADMINISTRATIVE = (".ds_store", "manifest.csv", "manifest.json", "metadata.csv", "metadata.json", "thumbs.db")
ARCHIVES = ("7z", "bz2", "gz", "rar", "tar", "tgz", "xz", "zip")
SIDECARS = ("db", "idx", "index", "lock", "log", "shm", "sqlite", "sqlite3", "wal")
MOST_BYTES = 100 * 1024 * 1024


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


def language_of(path: Column) -> Column:
    name = file_name(path)
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return (
        F.when(name.isin("Dockerfile", "Containerfile"), "dockerfile").when(F.lower(name).isin(*LOCK_FILES), "lockfile").otherwise(F.coalesce(F.try_element_at(table, suffix(path)), F.lit("text")))
    )


def is_safe(path: Column) -> Column:
    """Relative, without parent steps, drive or null character."""
    return ~path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|\x00") & (F.trim(path) != "")


def holds_secret(text: Column) -> Column:
    return F.substring(text, 1, SECRET_BYTES).rlike("|".join(SECRETS))


@pandas_udf(BooleanType())
def is_binary(content: pd.Series) -> pd.Series:
    """Over 1 % null or over 15 % control bytes among the first 8192."""

    def check(data: bytes | None) -> bool:
        head = (data or b"")[:8192]
        if not head:
            return False
        control = sum(b < 32 and b not in b"\t\n\r\f\b" for b in head)
        return head.count(0) > 0.01 * len(head) or control > 0.15 * len(head)

    return content.map(check)


def admission(files: DataFrame) -> DataFrame:
    """Each file with the first reason against it, null if it is admitted (columns path, size)."""
    path, low = F.col("path"), F.lower("path")
    directories = F.slice(F.split(low, "/"), F.lit(1), F.greatest(F.size(F.split(low, "/")) - 1, F.lit(0)))
    name, end = F.lower(file_name(path)), suffix(path)
    reason = (
        F.when(~is_safe(path), "outside_source_root")
        .when(F.arrays_overlap(directories, F.array(*map(F.lit, SKIPPED_DIRECTORIES))), "excluded_directory")
        .when(name.isin(*ADMINISTRATIVE), "excluded_administrative_file")
        .when(F.startswith(name, F.lit("~$")) | F.startswith(name, F.lit(".~lock.")), "excluded_sidecar_file")
        .when(end.isin(*ARCHIVES), "excluded_archive")
        .when(end.isin(*SIDECARS), "excluded_sidecar_file")
        .when(~end.isin(*DOCUMENT_SUFFIXES), "unsupported_extension")
        .when(F.col("size") > MOST_BYTES, "file_too_large")
    )
    return files.withColumn("reason", reason)


#: Directories, names and suffixes of files that are no source.
SOURCE_SKIPPED = (".git", ".venv", ".venv312", "venv", "node_modules", "dist", "build", "coverage", "htmlcov", ".next", ".cache", ".pytest_cache", ".mypy_cache", ".ruff_cache", "storage", "qdrant_data", "qdrant_storage", "__pycache__")
SECRET_NAMES = (".env", ".env.local", "id_rsa", "id_ed25519", "credentials.json", "secrets.json")
SECRET_SUFFIXES = ("jks", "key", "keystore", "p12", "pfx", "pem")
GENERATED_NAMES = ("test_out.json", "coverage.json", "lcov.info", "junit.xml")
BINARY_SUFFIXES = ("7z", "avi", "bin", "bmp", "class", "db", "dll", "doc", "docx", "dylib", "exe", "gif", "gz", "ico", "jar", "jpeg", "jpg", "lockb", "mp3", "mp4", "o", "obj", "otf", "pdf", "png", "pyc", "sqlite", "sqlite3", "so", "tar", "tgz", "ttf", "wav", "webp", "woff", "woff2", "xls", "xlsx", "zip")
SOURCE_BYTES = 2_000_000


def source_admission(files: DataFrame) -> DataFrame:
    """Each source file with the first reason against it, null if it is admitted.

    Columns path, size, text; ``link`` (null, inside or outside), if there is one, tells symbolic links.
    """
    path, name, end = F.col("path"), F.lower(file_name(F.col("path"))), F.lower(suffix(F.col("path")))
    plain = F.translate(path, "\\", "/")
    parts = F.split(plain, "/")
    escapes = (plain == "") | F.startswith(plain, F.lit("/")) | plain.rlike("^.:") | F.array_contains(parts, "..")
    link = F.col("link") if "link" in files.columns else F.lit(None).cast("string")
    secret = name.isin(*SECRET_NAMES) | (name == ".env") | F.startswith(name, F.lit(".env.")) | end.isin(*SECRET_SUFFIXES) | name.isin("credentials", "secrets")
    reason = (
        F.when(escapes, "excluded_path_escape")
        .when(F.arrays_overlap(parts, F.array(*map(F.lit, SOURCE_SKIPPED))), "excluded_path")
        .when(link == "outside", "excluded_symlink_escape")
        .when(link.isNotNull(), "excluded_symlink")
        .when(secret, "excluded_secret")
        .when(name.isin(*GENERATED_NAMES), "excluded_generated")
        .when(end.isin(*BINARY_SUFFIXES), "excluded_binary")
        .when(F.col("size") > SOURCE_BYTES, "excluded_large_file")
        .when(F.coalesce(holds_secret(F.col("text")), F.lit(False)), "excluded_secret_content")
        .when(F.coalesce(is_binary(F.encode("text", "UTF-8")), F.lit(False)), "excluded_binary_content")
    )
    return files.withColumn("reason", reason)


def import_outcomes(files: DataFrame, known: DataFrame) -> DataFrame:
    """created, deduplicated or skipped for each file (columns path, size, checksum), against known checksums."""
    rows = admission(files)
    first = rows.where("reason IS NULL").groupBy("checksum").agg(F.min("path").alias("first_path"))
    marked = rows.join(first, "checksum", "left").join(known.select("checksum", F.lit(True).alias("known")).distinct(), "checksum", "left")
    outcome = F.when(F.col("reason").isNotNull(), "skipped").when(F.col("known") | (F.col("path") != F.col("first_path")), "deduplicated").otherwise("created")
    return marked.select("path", "reason", outcome.alias("outcome"))


def scan_directory(spark: SparkSession, root: str, most_files: int | None = None) -> DataFrame:
    """Files below a directory: path, size, content_hash, language, text; binaries and what lies in skipped directories are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace("path", "^(file:)?/*" + re.escape(base.lstrip("/")), "")
    kept = raw.withColumn("path", path).where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SOURCE_SKIPPED))))
    rows = kept.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), "content")
    rows = rows.where(~is_binary("content")).select("path", "size", "content_hash", language_of(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("text"))
    if most_files is not None and rows.count() > most_files:
        raise ValueError(f"more than {most_files} files below {root}")
    return rows


def changed_since(scan: DataFrame, again: DataFrame) -> DataFrame:
    """Paths whose size or hash differs between two scans, or that only one has."""
    a, b = scan.select("path", F.col("content_hash").alias("a")), again.select("path", F.col("content_hash").alias("b"))
    return a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def git_statuses(porcelain: str) -> list[tuple[str, str]]:
    """(path, status) of the records of a null-separated status listing; a rename takes two."""
    out, records = [], iter(porcelain.split("\0"))
    for r in records:
        if len(r) > 3:
            out.append((r[3:], r[:2].strip() or "clean"))
            if "R" in r[:2] or "C" in r[:2]:
                next(records, None)
    return out
