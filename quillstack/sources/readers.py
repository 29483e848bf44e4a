"""Readers for documents, records and transcripts, and writers for traces."""

from __future__ import annotations

import html as html_entities
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: Columns of imported records under the names they are known by.
ALIASES = {
    "id": ("id", "key", "external_id", "identifiant", "ref"),
    "title": ("title", "titre", "subject", "name", "summary", "objet"),
    "text": ("text", "content", "body", "description", "notes", "contenu"),
    "author": ("author", "auteur", "reporter", "owner", "from"),
    "date": ("date", "updated_at", "created_at", "updated", "modified"),
    "tags": ("tags", "labels", "keywords", "etiquettes"),
    "classification": ("classification", "level", "niveau", "confidentiality"),
}
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")


def detect_format(path: Column) -> Column:
    """Kind of a file by its ending."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html", "json": "json", "ndjson": "json", "jsonl": "json", "csv": "csv", "tsv": "csv", "vtt": "transcript", "srt": "transcript", "docx": "docx", "pdf": "pdf"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), end), F.lit("unknown"))


def sniff_format(path: Column, content: Column) -> Column:
    """Kind of a file by its ending and, where that tells nothing, by its first bytes: archives, PDF, pages, JSON, cues, then text."""
    head = F.lower(F.trim(F.decode(F.substring(content, 1, 256), "ISO-8859-1")))
    by_content = (
        F.when(F.substring(content, 1, 4) == F.unhex(F.lit("504B0304")), "docx")
        .when(head.startswith("%pdf"), "pdf")
        .when(head.startswith("webvtt"), "transcript")
        .when(head.rlike(r"^(<!doctype html|<html|<head|<body)"), "html")
        .when(head.rlike(r"^[\[{]"), "json")
        .when(~head.rlike(r"[\x00-\x08\x0E-\x1F]"), "text")
        .otherwise("unknown")
    )
    named = detect_format(path)
    return F.when(named == "unknown", by_content).otherwise(named)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, front_matter, text): one row per file; the title is the front matter's or the first heading."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    return markdown_columns(raw)


def markdown_columns(raw: DataFrame) -> DataFrame:
    front = F.regexp_extract("raw", r"(?s)\A---\n(.*?)\n---\n", 1)
    text = F.regexp_replace("raw", r"(?s)\A---\n.*?\n---\n", "")
    named = F.regexp_extract(front, r"(?m)^title:\s*[\"']?(.*?)[\"']?\s*$", 1)
    heading = F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1)
    title = F.coalesce(F.nullif(named, F.lit("")), F.nullif(heading, F.lit("")))
    return raw.select("path", title.alias("title"), F.nullif(front, F.lit("")).alias("front_matter"), F.trim(text).alias("text"))


def read_files(spark: SparkSession, path: str, extractors: dict[str, Callable[[bytes], str]]) -> DataFrame:
    """(path, kind, text) of binary files through a registry from kind to function; other kinds have null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extractors[k](bytes(c)) if k in extractors else None for k, c in zip(batch["kind"], batch["content"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "kind": batch["kind"], "text": texts})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", detect_format(F.col("path")).alias("kind"), "content").mapInPandas(run, "path string, kind string, text string")


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word file as Markdown: headings, list items, table rows."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    say = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    lines = []
    for node in body:
        if node.tag == f"{w}p":
            style = node.find(f"{w}pPr/{w}pStyle")
            name = style.get(f"{w}val", "") if style is not None else ""
            level = re.match(r"(?:Heading|Titre)(\d)", name)
            text = say(node)
            if text.strip():
                lines.append(("#" * int(level[1]) + " " if level else "- " if node.find(f"{w}pPr/{w}numPr") is not None else "") + text)
        elif node.tag == f"{w}tbl":
            lines += ["| " + " | ".join(say(cell) for cell in row.iter(f"{w}tc")) + " |" for row in node.iter(f"{w}tr")]
    return "\n".join(lines)


#: Elements whose text is not content.
NOISE = frozenset("script style noscript nav header footer aside form button svg iframe template select option input canvas dialog menu object".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    """Collects a page's title, language and text as Markdown-like lines, from main or article where there is one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.lang, self.lines, self.current, self.prefix = "", "", [], [], ""
        self.stack: list[tuple[str, bool, bool]] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "html":
            self.lang = given.get("lang") or ""
        above = self.stack[-1] if self.stack else ("", False, False)
        noise = above[1] or tag in NOISE or given.get("aria-hidden") == "true" or bool(re.search(r"\b(cookie|banner|sidebar|advert|breadcrumb)\b", f"{given.get('class') or ''} {given.get('id') or ''}"))
        main = above[2] or tag in ("main", "article") or given.get("role") in ("main", "article")
        if tag in ("p", "div", "br", "tr", "table", "ul", "ol", "section", "article", "main") or re.fullmatch("h[1-6]|li", tag):
            self._flush()
        if re.fullmatch("h[1-6]", tag):
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.prefix = "- "
        elif tag in ("td", "th"):
            self.current.append((" | ", main, noise))
        if tag not in VOID:
            self.stack.append((tag, noise, main))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack):
            if tag in ("p", "div", "li", "tr", "title", "section", "article", "main") or re.fullmatch("h[1-6]", tag):
                self._flush()
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        tag, noise, main = self.stack[-1] if self.stack else ("", False, False)
        if tag == "title":
            self.title += data
        elif not any(t == "head" for t, _, _ in self.stack):
            self.current.append((data, main, noise))

    def _flush(self):
        kept = [(d, m) for d, m, noise in self.current if not noise]
        text = re.sub(r"\s+", " ", "".join(d for d, _ in kept)).strip()
        if text.strip("| "):
            self.lines.append((self.prefix + text, any(m for _, m in kept)))
        self.current, self.prefix = [], ""

    def result(self) -> tuple[str, str, str]:
        self._flush()
        inside = [line for line, main in self.lines if main]
        return html_entities.unescape(self.title).strip(), self.lang, "\n".join(inside or [line for line, _ in self.lines])


def html_text(page: str | None) -> tuple[str, str, str]:
    """(title, lang, text) of a page."""
    parser = _Page()
    parser.feed(page or "")
    parser.close()
    return parser.result()


def extract_html(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, title, lang, text): one row per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [html_text(h) for h in batch["h"]]
            yield pd.DataFrame({key: batch["k"], "title": [r[0] for r in rows], "lang": [r[1] for r in rows], "text": [r[2] for r in rows]})

    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"{key} long, title string, lang string, text string")


def parse_date(text: Column) -> Column:
    """Timestamps in the usual written forms, and epochs in seconds or milliseconds."""
    text = F.trim(text)
    epoch = F.when(text.rlike(r"^\d{10}$"), F.timestamp_seconds(text.try_cast("long"))).when(text.rlike(r"^\d{13}$"), F.timestamp_millis(text.try_cast("long")))
    return F.coalesce(epoch, *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def parse_level(text: Column) -> Column:
    low = F.lower(F.trim(text))
    words = {"public": 0, "c0": 0, "interne": 1, "internal": 1, "c1": 1, "confidentiel": 2, "confidential": 2, "c2": 2, "secret": 3, "c3": 3}
    return F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), low)


def map_records(records: DataFrame) -> DataFrame:
    """(id, title, text, author, date, tags, classification) of records read as strings, by the first alias that has a value."""
    lower = {c.lower(): c for c in records.columns}

    def first(name: str) -> Column:
        known = [F.nullif(F.trim(F.col(f"`{lower[a]}`").cast("string")), F.lit("")) for a in ALIASES[name] if a in lower]
        return F.coalesce(*known, F.lit(None).cast("string")) if known else F.lit(None).cast("string")

    tags = F.filter(F.transform(F.split(F.coalesce(first("tags"), F.lit("")), r"[,;|]"), lambda t: F.trim(t)), lambda t: t != "")
    return records.select(first("id").alias("id"), first("title").alias("title"), first("text").alias("text"), first("author").alias("author"), parse_date(first("date")).alias("date"), F.array_distinct(tags).alias("tags"), parse_level(first("classification")).alias("classification"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV as strings; the separator is the most frequent of ``, ; tab |`` in the first line, repeated headers get Spark's numbers."""
    head = (spark.read.text(path).limit(1).collect() or [[""]])[0][0]
    separator = max(",;\t|", key=head.count)
    frame = spark.read.option("sep", separator).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return frame.toDF(*[c.strip().lower() for c in frame.columns])


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Lines of JSON, an array, or an object that wraps an array under items, records, data or results."""
    reader = spark.read.schema(schema) if schema else spark.read
    lines = reader.option("mode", "PERMISSIVE").json(path)
    if "_corrupt_record" in lines.columns:
        lines = reader.option("multiLine", True).json(path)
    for name in ("items", "records", "data", "results"):
        if name in lines.columns and isinstance(lines.schema[name].dataType, T.ArrayType):
            return lines.select(F.explode(name).alias("r")).select("r.*")
    return lines


CUE = r"(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})\s*-->\s*(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})"


def parse_transcript(files: DataFrame) -> DataFrame:
    """(path, cue, start_s, end_s, speaker, text) of WebVTT and SubRip texts in (path, raw); a speaker holds until the next is named."""
    blocks = files.select("path", F.posexplode(F.split(F.regexp_replace("raw", "\r\n?", "\n"), r"\n[ \t]*\n")).alias("cue", "block")).where(F.col("block").rlike(CUE))
    part = lambda i: F.coalesce(F.regexp_extract("block", CUE, i).try_cast("double"), F.lit(0.0))
    seconds = lambda i: part(i) * 3600 + part(i + 1) * 60 + part(i + 2) + part(i + 3) / 1000
    said = F.regexp_replace("block", r"(?s)\A.*?-->[^\n]*\n", "")
    voice = F.coalesce(F.nullif(F.regexp_extract(said, r"<v(?:\.[^ >]+)?\s+([^>]+)>", 1), F.lit("")), F.nullif(F.regexp_extract(said, r"\A([A-ZÀ-Ý][\w .'-]{1,40}?)\s*:\s", 1), F.lit("")))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(said, r"<[^>]+>", ""), r"\A[A-ZÀ-Ý][\w .'-]{1,40}?\s*:\s", ""), r"\s+", " "))
    rows = blocks.select("path", "cue", seconds(1).alias("start_s"), seconds(5).alias("end_s"), voice.alias("voice"), text.alias("text"))
    speaker = F.last("voice", ignorenulls=True).over(Window.partitionBy("path").orderBy("cue"))
    return rows.withColumn("speaker", speaker).drop("voice")


def parse_spoken_lines(files: DataFrame) -> DataFrame:
    """(path, cue, start_s, end_s, speaker, text) of plain transcripts in (path, raw): lines ``[time] Speaker: text``; others go on."""
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("raw", "\r\n?", "\n"), "\n")).alias("cue", "line")).where(F.trim("line") != "")
    pattern = r"^\s*(?:\[?(?:(\d+):)?(\d{1,2}):(\d{2})\]?\s*[-–]?\s*)?(?:([A-ZÀ-Ý][\w .'-]{1,40}?)\s*:\s+)?(.*)$"
    part = lambda i: F.nullif(F.regexp_extract("line", pattern, i), F.lit(""))
    number = lambda i: F.coalesce(part(i).cast("double"), F.lit(0.0))
    at = F.when(part(3).isNotNull(), number(1) * 3600 + number(2) * 60 + number(3))
    rows = lines.select("path", "cue", at.alias("at"), part(4).alias("voice"), F.trim(F.coalesce(part(5), F.lit(""))).alias("text"))
    ordered = Window.partitionBy("path").orderBy("cue")
    carried = lambda c: F.last(c, ignorenulls=True).over(ordered)
    start = F.coalesce(carried("at"), F.lit(0.0))
    return rows.select("path", "cue", start.alias("start_s"), start.alias("end_s"), carried("voice").alias("speaker"), "text")


def merge_cues(cues: DataFrame, gap: float = 5.0, most: int = 1200) -> DataFrame:
    """(path, start_s, end_s, speaker, text): cues of one speaker in a row, while the pause is short and the text below a length."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in rows.sort_values("cue").itertuples():
            if out and out[-1][3] == r.speaker and r.start_s - out[-1][2] <= gap and len(out[-1][4]) + len(r.text) < most:
                out[-1][2], out[-1][4] = r.end_s, f"{out[-1][4]} {r.text}"
            else:
                out.append([r.path, r.start_s, r.end_s, r.speaker, r.text])
        return pd.DataFrame(out, columns=["path", "start_s", "end_s", "speaker", "text"])

    return cues.groupBy("path").applyInPandas(run, "path string, start_s double, end_s double, speaker string, text string")


def strip_quoted(mail: Column) -> Column:
    """A mail's own text: quoted lines, the lines that introduce them and signatures go."""
    out = F.regexp_replace(mail, r"(?s)\n(On .{0,120} wrote:|Le .{0,120} a écrit\s?:|-{2,}\s?(Original Message|Message d'origine)).*\z", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?m)^>.*\n?", ""), r"(?s)\n-- \n.*\z", ""))


def thread_markdown(mails: DataFrame, thread: str = "thread_id") -> DataFrame:
    """(thread, markdown): a thread's mails in order, each under its sender and date."""
    part = F.concat(F.lit("### "), F.col("sender"), F.lit(" — "), F.date_format("at", "yyyy-MM-dd HH:mm"), F.lit("\n"), strip_quoted(F.col("body")))
    ordered = F.array_sort(F.collect_list(F.struct("at", "mail_id", part.alias("part"))))
    return mails.groupBy(thread).agg(F.array_join(F.transform(ordered, lambda m: m["part"]), "\n\n").alias("markdown"))


def sync_actions(incoming: DataFrame, current: DataFrame, key: str = "external_id") -> DataFrame:
    """(key, action) of a full sync: insert, update, delete, keep."""
    a = incoming.select(key, F.col("content_hash").alias("new_hash"))
    b = current.select(key, F.col("content_hash").alias("old_hash"))
    action = F.when(F.col("old_hash").isNull(), "insert").when(F.col("new_hash").isNull(), "delete").when(F.col("old_hash") != F.col("new_hash"), "update").otherwise("keep")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def apply_sync(incoming: DataFrame, current: DataFrame, key: str = "external_id") -> DataFrame:
    """The table after a full sync: new and changed rows as they came, unchanged ones as they are, missing ones marked as forgotten."""
    acts = sync_actions(incoming, current, key).select(F.col(key).alias("_k"), "action")
    came = incoming.join(acts.where("action IN ('insert', 'update')"), F.col(key) == F.col("_k"), "left_semi").withColumn("status", F.lit("active"))
    left = current.join(acts.where("action IN ('keep', 'delete')"), F.col(key) == F.col("_k")).withColumn("status", F.when(F.col("action") == "delete", "forgotten").otherwise("active"))
    return came.select(key, "content_hash", "status").unionByName(left.select(key, "content_hash", "status"))


def write_traces(requests: DataFrame, decisions: DataFrame, feedback: DataFrame, path: str, key: str = "request_id") -> None:
    """Newline-delimited JSON: each request with its decisions in rank order and its feedback."""
    trace_records(requests, decisions, feedback, key).write.mode("errorifexists").json(path)


def trace_records(requests: DataFrame, decisions: DataFrame, feedback: DataFrame, key: str = "request_id") -> DataFrame:
    d = decisions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*sorted(c for c in decisions.columns if c != key)))).alias("decisions"))
    f = feedback.groupBy(key).agg(F.collect_list(F.struct(*[c for c in feedback.columns if c != key])).alias("feedback"))
    return requests.join(d, key, "left").join(f, key, "left")


def upsert_index(index: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """An index table with changed rows put in place of those of the same key; rows with a true ``deleted`` only remove."""
    kept = index.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes.where(~F.col("deleted")).select(*index.columns))
