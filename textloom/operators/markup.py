"""Inline markup: tokens, depth and attributes with SQL functions, and a full parse into node rows."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format: marks that open a span, the mark that closes one, and the marks of a note, a title and an image.
SPANS = ("zp", "mp", "zpsc", "sc", "fu", "wz", "T")
HIDDEN, VERSE = ("zp", "mp", "zpsc", "T"), ("sc", "fu")
TOKEN = re.compile(r"\\(.|\n)|\[-\]|\[img:([^\]\n]*)\]|\[(zpsc|zp|mp|sc|fu|wz|T)\]")
FILE = re.compile(r"^[\w㐀-鿿-]+(?:\.[\w-]+)*\.(?:png|jpe?g|webp|svg)$")

NODES = "{key} {kind}, node_id int, parent_id int, depth int, path array<string>, type string, kind string, value string, offset int, line int, col int, error string"


def parse(source: str | None) -> list[tuple]:
    """Nodes of a marked-up text in preorder: (id, parent, depth, path, type, kind, value, offset, line, col, error).

    Marks nest; [-] closes the innermost; a title closes at the end of its line; a backslash makes the next
    character plain and, before a line end, a hard break. Errors are nodes of type 'error' at their place: a close
    without an open mark, an unclosed mark, an empty note, an image name that is not allowed.
    """
    text, out, stack = source or "", [], []
    at, pending, start = 0, [], None
    lines = [0, *(m.end() for m in re.finditer("\n", text))]

    def place(offset: int) -> tuple[int, int]:
        import bisect

        line = bisect.bisect_right(lines, offset) - 1
        return line + 1, offset - lines[line] + 1

    def add(type_: str, kind: str | None, value: str | None, offset: int, error: str | None = None) -> int:
        parent = stack[-1][0] if stack else None
        out.append((len(out), parent, len(stack), [k for _, k, _ in stack], type_, kind, value, offset, *place(offset), error))
        return len(out) - 1

    def flush() -> None:
        nonlocal pending, start
        if pending:
            add("text", None, "".join(pending), start)
        pending, start = [], None

    def plain(s: str, offset: int) -> None:
        nonlocal start
        if s:
            start = offset if start is None else start
            pending.append(s)

    def close(offset: int) -> None:
        node, kind, opened = stack.pop()
        if kind == "wz" and not any(n[1] == node for n in out[node + 1 :]):
            add("error", kind, None, opened, "empty note")

    while at < len(text):
        m = TOKEN.search(text, at)
        until = m.start() if m else len(text)
        while stack and stack[-1][1] == "T" and (line_end := text.find("\n", at, until)) >= 0:
            plain(text[at:line_end], at)
            flush()
            close(line_end)
            plain("\n", line_end)
            at = line_end + 1
        plain(text[at:until], at)
        if not m:
            break
        at = until
        if m[1] is not None:
            if m[1] == "\n":
                flush()
                add("hard-break", None, None, at)
            else:
                plain(m[1], at)
        elif m[0] == "[-]":
            flush()
            if stack:
                close(at)
            else:
                add("error", None, None, at, "close without an open mark")
        elif m[2] is not None:
            flush()
            add("image", None, m[2], at, None if FILE.match(m[2]) else "image name is not allowed")
        else:
            flush()
            stack.append((add("mark", m[3], None, at), m[3], at))
        at = m.end()
    flush()
    for _, kind, opened in reversed(stack):
        if kind != "T":
            line, col = place(opened)
            out.append((len(out), None, 0, [], "error", kind, None, opened, line, col, "unclosed mark"))
    return out


def nodes(docs: DataFrame, key: str = "source_id", text: str = "body") -> DataFrame:
    """One row a node of each text; see parse. Null and empty texts have none."""
    names = ["node_id", "parent_id", "depth", "path", "type", "kind", "value", "offset", "line", "col", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *n) for k, t in zip(f["key"], f["text"]) for n in parse(t)]
            frame = pd.DataFrame(rows, columns=[key, *names])
            yield frame.astype({"parent_id": "Int32"})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, NODES.format(key=key, kind=kind))


def tracks(parsed: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, prose, verse): text outside hidden marks; text inside verse marks goes to verse."""
    hidden = F.arrays_overlap("path", F.array(*map(F.lit, (*HIDDEN, "wz"))))
    verse = F.arrays_overlap("path", F.array(*map(F.lit, VERSE)))
    seen = parsed.filter((F.col("type") == "text") & ~hidden).withColumn("verse", verse)

    def joined(which: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("node_id", "value")))), lambda n: n["value"]), "")

    return seen.groupBy(key).agg(joined(~F.col("verse")).alias("prose"), joined(F.col("verse")).alias("verse"))


def numbered_notes(parsed: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, number, text): notes in order of appearance, numbered from 1."""
    notes = parsed.filter("type = 'mark' and kind = 'wz'").select(key, "node_id", F.row_number().over(Window.partitionBy(key).orderBy("offset")).alias("number"))
    text = parsed.filter("type = 'text'").select(F.col(key).alias("k"), F.col("parent_id"), "value", F.col("node_id").alias("n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), "")
    return notes.join(text, (F.col(key) == F.col("k")) & (F.col("node_id") == F.col("parent_id")), "left").groupBy(key, "number").agg(body.alias("text"))


VOICE = re.compile(r"(?P<plain>\\\[)|\[voice:(?P<voice>[a-z0-9-]+)\|(?P<emotion>[a-z-]+)\]|(?P<bad>\[voice:)|(?P<close>\[-\])|(?P<open>\[(?:zpsc|zp|mp|sc|fu|wz|T)\])")


def voice_spans(source: str | None) -> list[tuple]:
    """(offset, voice, emotion, text, problem) of a text in which [voice:id|emotion] ... [-] says who speaks.

    Text outside has no voice. Other marks inside a voice keep their own closing marks. Voices do not nest; a text that
    breaks a rule gives one row with the problem.
    """
    text, out, voice, depth, start = source or "", [], (None, None), 0, 0
    for m in VOICE.finditer(text):
        kind, inside = m.lastgroup, voice[0] is not None
        if kind == "bad" or (kind == "emotion" and inside):
            return [(m.start(), None, None, None, "bad voice mark" if kind == "bad" else "voice inside a voice")]
        if kind == "open" and inside:
            if m.group() == "[T]":
                return [(m.start(), None, None, None, "title inside a voice")]
            depth += 1
        elif kind == "close" and inside and depth:
            depth -= 1
        elif kind == "emotion" or (kind == "close" and inside):
            out.append((start, *voice, text[start : m.start()], None))
            voice, start = ((m["voice"], m["emotion"]) if kind == "emotion" else (None, None)), m.end()
    if voice[0] is not None:
        return [(start, None, None, None, "voice not closed")]
    return [s for s in [*out, (start, *voice, text[start:], None)] if s[3]]


def voice_table(docs: DataFrame, key: str = "source_id", text: str = "body") -> DataFrame:
    """One row a voice span of each text; see voice_spans. Null and empty texts have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *s) for k, t in zip(f["key"], f["text"]) for s in voice_spans(t)], columns=["key", "offset", "voice", "emotion", "text", "problem"], dtype=object)

    kind = docs.schema[key].dataType.simpleString()
    spans = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, offset int, voice string, emotion string, text string, problem string")
    return spans.withColumnRenamed("key", key)


def voice_runs(spans: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, run, voice, emotion, characters): neighbouring spans of the same voice and emotion as one; rows with a problem are left out."""
    w = Window.partitionBy(key).orderBy("offset")
    own = F.struct("voice", "emotion")
    new = ~own.eqNullSafe(F.lag(own).over(w)) | (F.row_number().over(w) == 1)
    marked = spans.filter("problem is null").withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    return marked.groupBy(key, "run", "voice", "emotion").agg(F.sum(F.length("text")).alias("characters"))


def escape_html(text: Column) -> Column:
    """&, <, >, \" and ' as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def rendered(parsed: DataFrame, key: str = "source_id", images: str = "/images/") -> DataFrame:
    """(key, html) of each parsed text: marks as spans of their kind, titles as headings, notes with their number.

    Texts are escaped, hard breaks and images become their tags. What a node closes is the difference of its depth and
    the depth left open by the node before it, so one window over a document's nodes finds all closing tags. Documents with an
    error node have null html.
    """
    w = Window.partitionBy(key).orderBy("node_id")
    kind, is_mark = F.col("kind"), F.col("type") == "mark"
    tag = F.when(kind == "T", "h1").when(kind == "wz", "aside").otherwise("span")
    number = F.sum(F.when(is_mark & (kind == "wz"), 1).otherwise(0)).over(w)
    opened = F.when(kind == "T", "<h1>").when(kind == "wz", F.format_string('<aside data-note="%d">', number)).otherwise(F.concat(F.lit('<span class="'), kind, F.lit('">')))
    own = (
        F.when(is_mark, opened).when(F.col("type") == "text", escape_html(F.col("value"))).when(F.col("type") == "hard-break", "<br>")
        .when(F.col("type") == "image", F.concat(F.lit(f'<img src="{images}'), escape_html(F.col("value")), F.lit('">')))
    )
    # tags open after each node, outermost first: those of its path, and its own
    path = F.transform("path", lambda k: F.when(k == "T", "h1").when(k == "wz", "aside").otherwise("span"))
    left_open = F.when(is_mark, F.concat(path, F.array(tag))).otherwise(path)
    rows = parsed.withColumns({"_own": F.coalesce(own, F.lit("")), "_open": left_open, "_next": F.coalesce(F.lead("depth").over(w), F.lit(0))})
    closing = F.slice("_open", F.col("_next") + 1, F.greatest(F.size("_open") - F.col("_next"), F.lit(0)))
    ends = F.array_join(F.transform(F.reverse(closing), lambda t: F.concat(F.lit("</"), t, F.lit(">"))), "")
    parts = rows.select(key, "type", "node_id", F.concat("_own", ends).alias("html"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "html"))), lambda n: n["html"]), "")
    return parts.groupBy(key).agg(F.when(~F.bool_or(F.col("type") == "error"), joined).alias("html"))


@F.pandas_udf(T.StringType())
def unescape_html(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def tag_tokens(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """(key, tag, opened, closed): tags of a page and how often each opens and closes."""
    found = F.regexp_extract_all(F.coalesce(F.col(source), F.lit("")), F.lit("</?[a-zA-Z][a-zA-Z0-9]*"), 0)
    tags = pages.select(key, F.explode(found).alias("t")).select(key, F.lower(F.regexp_replace("t", "[</]", "")).alias("tag"), F.startswith("t", F.lit("</")).alias("closing"))
    return tags.groupBy(key, "tag").agg(F.count_if(~F.col("closing")).alias("opened"), F.count_if("closing").alias("closed"))


def tag_depth(pages: DataFrame, key: str = "page_id", source: str = "html", void: tuple[str, ...] = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")) -> DataFrame:
    """(key, tags, deepest, final): running depth over a page's tags in order, by a fold inside the row."""
    found = F.regexp_extract_all(F.coalesce(F.col(source), F.lit("")), F.lit("</?[a-zA-Z][a-zA-Z0-9]*"), 0)
    delta = F.transform(found, lambda t: F.when(F.lower(F.regexp_replace(t, "[</]", "")).isin(*void), 0).when(F.startswith(t, F.lit("</")), -1).otherwise(1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("deepest"))
    fold = F.aggregate(delta, start, lambda a, d: F.struct((a["now"] + d).alias("now"), F.greatest(a["deepest"], a["now"] + d).alias("deepest")))
    return pages.select(key, F.size(found).cast("long").alias("tags"), fold.alias("f")).select(key, "tags", F.col("f.deepest").cast("long").alias("deepest"), F.col("f.now").cast("long").alias("final"))


def attributes(pages: DataFrame, name: str, key: str = "page_id", source: str = "html") -> DataFrame:
    """(key, value, n): values of an attribute in each page, in double quotes."""
    values = F.regexp_extract_all(F.coalesce(F.col(source), F.lit("")), F.lit(f'\\b{name}="([^"]*)"'), 1)
    return pages.select(key, F.explode(values).alias("value")).groupBy(key, "value").agg(F.count("*").alias("n"))


def frontmatter(text: Column) -> Column:
    """The block between two --- lines at the start; empty if there is none."""
    return F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)


def without_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")


def frontmatter_list(text: Column, name: str) -> Column:
    """Items of a list in the front matter: quotes and bracketed remarks dropped, 2 to 20 characters."""
    block = F.regexp_extract(frontmatter(text), f"(?m)^{name}:\\s*\\n((?:\\s+-.*\\n?)+)", 1)
    items = F.regexp_extract_all(block, F.lit(r"(?m)^\s+-\s*(.+?)\s*$"), 1)
    clean = F.transform(items, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[\"']", ""), r"[（(][^）)]*[）)]", "")))
    return F.array_distinct(F.filter(clean, lambda x: F.length(x).between(2, 20)))
