"""Predicates and keys over file names and paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of files by extension, names that are never indexed, files that are safe to open.
KINDS = {"text": "txt log text", "markdown": "md markdown mdx", "pdf": "pdf", "docx": "docx", "code": "js jsx ts tsx mjs cjs py java cs go rs rb php kt swift c h cpp hpp cc sql sh ps1 psm1 bat cmd html htm css scss json yaml yml toml ini xml csv vue svelte lua r dart scala"}
EXCLUDED_DIRS = (".git", ".svn", ".hg", "node_modules", ".venv", "venv", "__pycache__", ".next", ".nuxt", "dist", "build", "out", "target", "bin", "obj", ".idea", ".vscode", ".cache", "coverage", "$recycle.bin", "system volume information")
BLOCKED_ROOTS = ("c:\\windows", "c:\\program files", "c:\\program files (x86)", "c:\\programdata")
OPENABLE = "txt log md markdown pdf docx doc rtf odt pptx xlsx csv png jpg jpeg gif webp bmp tiff".split()
MIB = 1 << 20


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.\\/]+)$", 1))


def kind_of(ext: Column) -> Column:
    """text, markdown, code, pdf or docx; null for what isn't indexed."""
    out = None
    for kind, exts in KINDS.items():
        out = F.when(ext.isin(*exts.split()), kind) if out is None else out.when(ext.isin(*exts.split()), kind)
    return out


def is_excluded_dir(name: Column) -> Column:
    return F.lower(name).isin(*EXCLUDED_DIRS) | F.startswith(name, F.lit("."))


def is_excluded_file(name: Column) -> Column:
    return F.startswith(name, F.lit("~$")) | F.startswith(name, F.lit("."))


def is_excluded_path(path: Column) -> Column:
    parts = F.split(path, r"[\\/]")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), is_excluded_dir) | is_excluded_file(F.element_at(parts, -1))


def size_cap(kind: Column) -> Column:
    return F.when(kind == "pdf", 200 * MIB).otherwise(50 * MIB).cast("long")


def path_key(path: Column) -> Column:
    """Case-insensitive identity of a path: one separator, no dot parts, no end separator."""
    out = F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), r"(/\.)+(?=/|$)", "")
    return F.lower(F.regexp_replace(out, r"/+$", ""))


def is_inside(path: Column, root: Column) -> Column:
    """Strictly inside: neither equal nor a mere prefix of a name, and no way out by "..". """
    return F.startswith(path_key(path), F.concat(path_key(root), F.lit("/"))) & ~path.rlike(r"(^|[\\/])\.\.([\\/]|$)")


def is_safe_local(path: Column) -> Column:
    """A drive path without NUL, network or device prefix and alternate stream."""
    return ~F.contains(path, F.lit("\0")) & ~path.rlike(r"^(\\\\|//)") & ~path.rlike(r"^..[^:]*:") & path.rlike(r"^[a-zA-Z]:[\\/]")


def blocked_reason(path: Column) -> Column:
    """Why a folder can't be added, or null."""
    key = F.replace(path_key(path), F.lit("/"), F.lit("\\"))
    system = None
    for root in BLOCKED_ROOTS:
        hit = (key == root) | F.startswith(key, F.lit(root + "\\"))
        system = hit if system is None else system | hit
    return F.when(key.rlike("^[a-z]:$"), "drive").when(system, "system").when(key.rlike(r"\\appdata\\(roaming|local)(\\|$)"), "application data")


def is_openable(ext: Column) -> Column:
    return F.lower(ext).isin(*OPENABLE)


def is_loopback(host: Column) -> Column:
    return F.lower(host).rlike(r"^\[?(localhost|::1|0:0:0:0:0:0:0:1|(::ffff:)?127\.\d+\.\d+\.\d+)\]?$")


def is_cloud_model(name: Column) -> Column:
    return F.lower(name).rlike(r"(^|[:-])cloud\b")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)
