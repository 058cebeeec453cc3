"""Papers from payloads: archives, TeX sources and text of pages, as tables of files and of sections."""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Members that may be taken from an archive, names of main files, and headings of papers without a table of contents.
SUFFIXES = (".tex", ".bbl", ".bib", ".sty", ".cls", ".clo", ".txt")
MAIN_NAMES = ("main", "paper", "ms", "manuscript", "arxiv")
HEADING_WORDS = "Abstract|Introduction|Related Work|Background|Method|Methods|Approach|Experiments?|Results?|Evaluation|Discussion|Conclusion|Conclusions|Limitations|References|Bibliography|Appendix"
NUMBERED = r"(?:(?:\d+\.)+\d*|\d+)\s+[A-Z][\w\-].{1,80}"
HEADING = re.compile(rf"(?:{NUMBERED}|(?:{HEADING_WORDS})\b.*)$", re.I)
LONGEST_HEADING = 90


def gunzip(data: bytes, most: int = 50_000_000) -> bytes | None:
    """The content of a gzip payload of at most `most` bytes, else null."""
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            out = f.read(most + 1)
        return out if len(out) <= most else None
    except (OSError, EOFError):
        return None


def safe_members(data: bytes, suffixes: tuple[str, ...] = SUFFIXES, most_files: int = 400, most_bytes: int = 80_000_000, depth: int = 8) -> list[tuple[str, bytes]]:
    """Files of a tar archive: plain ones with a known suffix, no links, nothing absolute or above the root, within limits of number, bytes and depth."""
    out, total = [], 0
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
            for m in tar:
                name = posixpath.normpath(m.name)
                if not m.isreg() or name.startswith(("/", "..")) or "\\" in name or name.count("/") >= depth or not name.lower().endswith(suffixes):
                    continue
                if len(out) >= most_files or total + m.size > most_bytes:
                    break
                total += m.size
                out.append((name, tar.extractfile(m).read()))
    except (tarfile.TarError, EOFError, OSError):
        pass
    return out


def unpack(payloads: DataFrame, **limits) -> DataFrame:
    """(key, path, text) of payloads (key, content BINARY): archive members, or one main.tex for a single source. Broken payloads and null content
    give no rows; bytes that are no UTF-8 are read as Latin-1."""

    def text(b: bytes) -> str:
        try:
            return b.decode()
        except UnicodeDecodeError:
            return b.decode("latin-1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, data in zip(b.key, b.content, strict=True):
                data = bytes(data)
                if data[:2] == b"\x1f\x8b":
                    data = gunzip(data) or b""
                files = safe_members(data, **limits)
                if not files and data and b"\0" not in data[:1000] and b"\\" in data:
                    files = [("main.tex", data)]
                rows += [(key, p, text(x)) for p, x in files]
            yield pd.DataFrame(rows, columns=["key", "path", "text"])

    return payloads.where("content is not null").select(F.col("key").cast("string").alias("key"), "content").mapInPandas(run, "key string, path string, text string")


def strip_comments(t: str) -> str:
    return "\n".join(re.sub(r"(?<!\\)%.*$", "", line).rstrip() for line in t.split("\n"))


def main_file(files: dict[str, str]) -> str | None:
    """The path most likely to be the main source: a document class and a document body count most, then its name, then a short path."""
    tex = [p for p in files if p.lower().endswith(".tex")]

    def rank(p: str) -> tuple:
        stem = posixpath.splitext(posixpath.basename(p))[0].lower()
        points = 10 * ("\\documentclass" in files[p]) + 10 * ("\\begin{document}" in files[p]) + 5 * (stem in MAIN_NAMES)
        return -points, p.count("/"), p

    return min(tex, key=rank, default=None)


def inline(files: dict[str, str], path: str, depth: int = 8, seen: frozenset[str] = frozenset()) -> str:
    """The text of path with its inputs in place, found beside it or at the root, never the same file inside itself."""
    here = posixpath.dirname(path)

    def put(m: re.Match) -> str:
        name = m[1].strip()
        for base in dict.fromkeys((here, "")):
            for p in (posixpath.normpath(posixpath.join(base, name)), posixpath.normpath(posixpath.join(base, name + ".tex"))):
                if p in files and p not in seen and p != path and depth > 0:
                    return inline(files, p, depth - 1, seen | {path})
        return ""

    return re.sub(r"\\(?:input|include|subfile)\s*\{([^{}]+)\}", put, strip_comments(files[path]))


def braced(t: str, command: str) -> str | None:
    """The argument of a command, with balanced braces; null if there is none or it never closes."""
    m = re.search(rf"\\{command}\*?\s*(?:\[[^\]]*\])?\s*\{{", t)
    if not m:
        return None
    level, i = 1, m.end()
    while i < len(t) and level:
        level += (t[i] == "{" and t[i - 1] != "\\") - (t[i] == "}" and t[i - 1] != "\\")
        i += 1
    return t[m.end() : i - 1] if not level else None


def to_text(t: str) -> str:
    """Plain text of markup: figures, commands and braces go, their arguments stay."""
    t = re.sub(r"\\begin\{(figure|table|equation|align)\*?\}.*?\\end\{\1\*?\}", " ", t, flags=re.S)
    t = re.sub(r"\\(?:cite[a-z]*|ref|label|eqref)\s*(?:\[[^\]]*\])?\{[^{}]*\}", "", t)
    t = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?", " ", t)
    return re.sub(r"[ \t]+", " ", re.sub(r"[{}~$]", " ", t)).strip()


def tex_sections(files: dict[str, str]) -> tuple[str, str, list[dict]]:
    """Title, abstract and sections (heading, level, text) of a source; what stands before the first heading is Preamble, a body without any Body."""
    path = main_file(files)
    if path is None:
        return "", "", []
    t = inline(files, path)
    title = to_text(braced(t, "title") or "")
    m = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", t, re.S)
    body = m[1] if m else t
    abstract = ""
    m = re.search(r"\\begin\{abstract\}(.*?)\\end\{abstract\}", body, re.S)
    if m:
        abstract, body = to_text(m[1]), body[: m.start()] + body[m.end() :]
    marks = list(re.finditer(r"\\(section|subsection|subsubsection)\*?\s*(?:\[[^\]]*\])?\{", body))
    out = []
    edges = [x.start() for x in marks] + [len(body)]
    before = to_text(body[: edges[0]])
    if before:
        out.append({"heading": "Preamble" if marks else "Body", "level": 1, "text": before})
    for m, until in zip(marks, edges[1:], strict=True):
        name = braced(body[m.start() : until], m[1]) or ""
        after = body[m.end() + len(name) + 1 : until]
        out.append({"heading": to_text(name), "level": 1 + ["section", "subsection", "subsubsection"].index(m[1]), "text": to_text(after)})
    return title, abstract, out


def normal(t: str) -> str:
    """Text without soft hyphens and hyphenated breaks, white space collapsed."""
    return re.sub(r"\s+", " ", re.sub(r"(\w)-\s+(\w)", r"\1\2", t.replace("­", ""))).strip()


def page_sections(text: str) -> tuple[str, str, list[dict]]:
    """Title, abstract and sections of the text of pages: cut at lines that read like headings, numbered or by their first word."""
    lines = re.sub(r"(\w)-\n(\w)", r"\1\2", text).splitlines()
    marks = [i for i, x in enumerate(lines) if len(x.strip()) < LONGEST_HEADING and HEADING.match(x.strip())]
    out = [{"heading": "Preamble", "level": 1, "text": normal("\n".join(lines[: marks[0]]))}] if marks else [{"heading": "Body", "level": 1, "text": normal(text)}]
    for at, until in zip(marks, [*marks[1:], len(lines)], strict=False):
        out.append({"heading": normal(lines[at]), "level": 1, "text": normal("\n".join(lines[at + 1 : until]))})
    return page_title(text), page_abstract(text, out), [s for s in out if s["text"]]


def contents_sections(pages: list[str], contents: list[tuple[int, str, int]]) -> list[dict]:
    """Sections by a table of contents (level, heading, page from 1): from the beginning of an entry's page to that of the next one's. A heading that its body
    repeats is cut off; entries beyond the last page and empty bodies give none."""
    starts = [0]
    for p in pages:
        starts.append(starts[-1] + len(p) + 1)
    blob = "\n".join(pages)
    place = lambda page: starts[max(page, 1) - 1] if page <= len(pages) else len(blob)
    out = []
    for (level, heading, page), after in zip(contents, [*contents[1:], None], strict=True):
        if page > len(pages):
            continue
        head, body = normal(heading), normal(blob[place(page) : place(after[2]) if after else len(blob)])
        if head and body.lower().startswith(head.lower()):
            body = body[len(head) :].strip()
        if body:
            out.append({"heading": head or "Section", "level": level, "text": body})
    return out or [{"heading": "Body", "level": 1, "text": normal(blob)}]


def page_title(text: str) -> str:
    """The first line of 12 to 180 characters that is no stamp of an archive."""
    return next((x.strip() for x in text.splitlines() if 12 <= len(x.strip()) <= 180 and not x.strip().lower().startswith("arxiv")), "")


def page_abstract(text: str, sections: list[dict]) -> str:
    """The section called abstract, else what stands between that word and the introduction."""
    own = next((s["text"] for s in sections if s["heading"].lower().strip() == "abstract"), "")
    if own:
        return own
    m = re.search(r"(?is)(?:^|\n)\s*abstract\s*(?:\n|:)\s*(.+?)\n\s*(?:(?:1\s+)?introduction\b|1\.)", text)
    return normal(m[1]) if m else ""


SECTIONS = "title string, abstract string, sections array<struct<heading:string,level:int,text:string>>"


def parse_tex(files: DataFrame) -> DataFrame:
    """(key, title, abstract, sections) of the files (key, path, text) of TeX sources; a key's files are those of one paper, within the limits of unpack."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(t.key.iloc[0], *tex_sections(dict(zip(t.path, t.text, strict=True))))], columns=["key", "title", "abstract", "sections"])

    return files.where("text is not null").groupBy("key").applyInPandas(run, f"key string, {SECTIONS}")


def parse_pages(pages: DataFrame) -> DataFrame:
    """(key, title, abstract, sections) of the text of pages (key, text), or of pages (key, pages ARRAY<STRING>, contents ARRAY<STRUCT<level, heading, page>>), whose table of contents
    counts where it isn't empty. Getting text out of a PDF needs a library that is no part of this engine. Null texts and lists give no rows."""
    listed = "pages" in pages.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not listed:
                rows = [(k, *page_sections(t)) for k, t in zip(b.key, b.text, strict=True)]
            else:
                rows = []
                for k, own, toc in zip(b.key, b.pages, b.contents, strict=True):
                    own = [p or "" for p in own]
                    title, abstract, sections = page_sections("\n".join(own))
                    if toc is not None and len(toc):
                        sections = contents_sections(own, [(int(e["level"]), e["heading"] or "", int(e["page"])) for e in toc])
                        abstract = page_abstract("\n".join(own), sections)
                    rows.append((k, title, abstract, sections))
            yield pd.DataFrame(rows, columns=["key", "title", "abstract", "sections"])

    cols = ["pages", "contents"] if listed else ["text"]
    return pages.where(F.col(cols[0]).isNotNull()).select(F.col("key").cast("string").alias("key"), *cols).mapInPandas(run, f"key string, {SECTIONS}")


def first_source(sources: DataFrame, order: tuple[str, ...] = ("tex", "pdf", "abstract")) -> DataFrame:
    """The best parsed source (key, source_kind, ...) of every paper: the first kind in order that has sections or an abstract."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*map(F.lit, order)), F.col("source_kind"))
    fine = sources.where((F.size(F.coalesce("sections", F.array())) > 0) | (F.coalesce("abstract", F.lit("")) != "")).where(rank > 0)
    return fine.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(rank))).where("r = 1").drop("r")
