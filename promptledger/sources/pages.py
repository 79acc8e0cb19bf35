"""HTML and text documents to Markdown."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import count_tokens

# Elements whose text is never content.
SKIPPED = {"script", "style", "nav", "noscript", "template", "svg"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "aside", "ul", "ol", "table",
          "blockquote", "pre", "figure", "form"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {f"h{n}": "#" * n for n in range(1, 7)}
BOLD = {"b", "strong"}
ITALIC = {"i", "em"}

# Accepted formats; anything else gets an error.
FORMATS = ("html", "htm", "txt", "md")


class _Markdown(HTMLParser):
    """Streams one page's tags into Markdown pieces.

    Open cells and rows end where the next one starts; a table inside a cell
    becomes text of that cell; a skipped element ends with its own end tag or
    with that of the block around it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.links: list[str | None] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.first_row = False
        self.tables: list[tuple] = []
        self.lists: list[int | None] = []
        self.blocks: list[str] = []  # open blocks around what is read
        self.skipped: list[str] = []  # the skipped element and what is open inside it

    def _put(self, text: str) -> None:
        (self.out if self.cell is None else self.cell).append(text)

    def _break(self) -> None:
        if self.cell is None:
            self.out.append("\n\n")
        else:
            self.cell.append(" ")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipped:
            if tag not in VOID:
                self.skipped.append(tag)
            return
        if tag in SKIPPED:
            self.skipped.append(tag)
            return
        if tag in BLOCKS or tag in ("body", "td", "th", "tr", "li"):
            self.blocks.append(tag)
        if tag in HEADINGS:
            self._break()
            self._put(HEADINGS[tag] + " ")
        elif tag == "title":
            self._put("# ")
        elif tag == "br":
            self._put("\n" if self.cell is None else " ")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
            self._put("\n")
        elif tag == "li":
            depth = max(len(self.lists) - 1, 0)
            mark = "-"
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                mark = f"{self.lists[-1]}."
            self._put("\n" + "  " * depth + mark + " ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            self._put("[")
        elif tag in BOLD:
            self._put("**")
        elif tag in ITALIC:
            self._put("*")
        elif tag == "img":
            alt = dict(attrs).get("alt")
            if alt:
                self._put(f"![{alt}]({dict(attrs).get('src') or ''})")
        elif tag == "tr":
            self._end_row()
            self.row = []
        elif tag in ("td", "th"):
            self._end_cell()
            self.row = [] if self.row is None else self.row
            self.cell = []
        elif tag == "table":
            self.tables.append((self.out, self.row, self.cell, self.first_row))
            if self.cell is None:
                self._break()
            else:
                self.out = []
            self.row, self.cell, self.first_row = None, None, True
        elif tag == "hr":
            self._put("\n\n---\n\n")
        elif tag in BLOCKS:
            self._break()

    def _end_cell(self) -> None:
        if self.cell is not None:
            text = " ".join("".join(self.cell).split()).replace("|", "\\|")
            self.cell = None
            self.row = [text] if self.row is None else [*self.row, text]

    def _end_row(self) -> None:
        self._end_cell()
        if self.row:
            self.out.append("\n| " + " | ".join(self.row) + " |")
            if self.first_row:
                self.out.append("\n|" + " --- |" * len(self.row))
                self.first_row = False
        self.row = None

    def _end_table(self) -> None:
        self._end_row()
        inner = self.out
        self.out, self.row, self.cell, self.first_row = self.tables.pop()
        if self.cell is None:
            self._break()
        else:
            rows = (line.strip("| ").replace(" | ", " ") for line in "".join(inner).split("\n"))
            self.cell.append(" " + " ".join(r for r in rows if r.strip("-| ")) + " ")

    def close(self) -> None:
        super().close()
        while self.tables:
            self._end_table()

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
                return
            if tag not in self.blocks:
                return
            self.skipped.clear()
        if tag in self.blocks:
            while self.blocks.pop() != tag:
                pass
        if tag == "table" and self.tables:
            self._end_table()
            return
        if tag == "a":
            href = self.links.pop() if self.links else None
            self._put(f"]({href or ''})")
        elif tag in BOLD:
            self._put("**")
        elif tag in ITALIC:
            self._put("*")
        elif tag in ("td", "th"):
            self._end_cell()
        elif tag == "tr":
            self._end_row()
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._put("\n")
        elif tag == "title" or tag in HEADINGS or tag in BLOCKS:
            self._break()

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            text = " ".join(data.split())
            if text:
                lead = " " if data[0].isspace() else ""
                trail = " " if data[-1].isspace() else ""
                self._put(lead + text + trail)
            elif data:
                self._put(" ")


def html_to_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    if parser.cell or parser.row:  # cells without a table
        parser._end_row()
    lines = [" ".join(line.split()) if line.lstrip()[:1] not in ("-", "|") else line.rstrip()
             for line in "".join(parser.out).split("\n")]
    kept: list[str] = []
    for line in lines:
        if line or (kept and kept[-1]):
            kept.append(line)
    return "\n".join(kept).strip()


# Pages of an Arrow batch that are converted and handed on together.
BATCH_ROWS = 64


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few pages at a time, so that Python holds the Arrow batch and little more, however long it is."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            rows = batch.slice(at, BATCH_ROWS)
            results, errors = [], []
            for text, kind in zip(rows.column("_text"), rows.column("_format")):
                text, kind = text.as_py(), kind.as_py()
                try:
                    if text is None:
                        raise ValueError("no document")
                    if kind not in FORMATS:
                        raise ValueError(f"unsupported format {kind}")
                    results.append(html_to_markdown(text) if kind.startswith("htm") else text)
                    errors.append(None)
                except Exception as problem:  # one bad document must not fail the job
                    results.append(None)
                    errors.append(str(problem))
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), pa.array(results, pa.string()), pa.array(errors, pa.string()), rows.column("_format"), rows.column("_size")],
                names=["_id", "markdown", "error", "_format", "_size"],
            )


def convert_pages(df: DataFrame, key: str = "page_id", text: str = "html", format_col: str | None = None) -> DataFrame:
    """Markdown, byte size, tokens and format of each document.

    Parsing is the one step without a Spark expression: it runs in Arrow
    batches over key and text only.  Size and tokens are native columns.
    Documents that cannot be converted keep a null ``markdown`` and an
    ``error``.
    """
    kind = F.lower(F.col(format_col)) if format_col else F.lit("html")
    slim = df.select(
        F.col(key).alias("_id"),
        F.col(text).alias("_text"),
        F.coalesce(kind, F.lit("")).alias("_format"),
        F.octet_length(text).cast("long").alias("_size"),
    )
    key_type = df.schema[key].dataType.simpleString()
    done = slim.mapInArrow(_convert, f"_id {key_type}, markdown string, error string, _format string, _size long")
    warnings = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array().cast("array<string>"))
    return done.select(
        F.col("_id").alias(key),
        "markdown",
        F.col("_size").alias("original_size_bytes"),
        count_tokens("markdown").alias("markdown_tokens"),
        F.col("_format").alias("format_detected"),
        warnings.alias("warnings"),
    )
