"""Review collections: a shortcut for each flagged row, and pages of links."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as afs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import order as O
from ..operators.scan import link_name
from .runs import put_text

#: The verdicts to review, worst first.
FLAGGED = ("BLOCK", "REVIEW", "ERROR")
#: Links of a page; a task holds one page.
PAGE = 1000


def file_uri(path: str) -> str:
    """A link to a path or uri, with other characters quoted."""
    scheme, rest = ("file", path) if path.startswith("/") else path.split(":", 1)
    rest = quote(rest, safe="/:@")
    return f"{scheme}:{rest if rest.startswith('//') else '//' + rest}"


def shortcut(uri: str) -> str:
    return f"[InternetShortcut]\nURL={uri}\n"


def page_name(page: int) -> str:
    return f"index-{page}.html" if page else "index.html"


def _page(verdict: str, page: int, last: bool, rows: pd.DataFrame) -> str:
    items = "\n".join(f'<li value="{i}"><a href="{escape(file_uri(p))}">{escape(p.rsplit("/", 1)[-1])}</a></li>' for i, p in zip(rows["index"], rows["path"], strict=True))
    near = [f'<a href="{page_name(page + step)}">{word}</a>' for step, word, there in ((-1, "previous", page), (1, "next", not last)) if there]
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{verdict} links</title><h1>{verdict}</h1><p>The links open the original files.</p><ol>\n{items}\n</ol>{" ".join(near)}</html>\n'


def write_links(rows: DataFrame, folder: str, run_id: str, policy: str, per_page: int = PAGE) -> dict[str, int]:
    """Shortcuts and pages of the flagged rows (index, path, score, verdict) below ``folder``, and an index of verdicts.

    Tasks write whole pages under fixed names, each file by a rename, so a repeated task writes the same again.
    """
    flagged = rows.where(F.col("verdict").isin(*FLAGGED)).select("index", "path", "verdict", link_name(F.col("index"), F.col("score"), F.col("path")).alias("name"))
    counts = {v: 0 for v in FLAGGED} | {r.verdict: r["count"] for r in flagged.groupBy("verdict").count().collect()}
    ranked = O.numbered(flagged, F.col("verdict"), F.col("index"), name="rank")
    starts, before = [], 0
    for v in sorted(counts):
        starts.append((v, before, (counts[v] - 1) // per_page))
        before += counts[v]
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "verdict string, before long, last_page long"))  # three rows
    paged = ranked.join(start, "verdict").withColumn("page", F.floor((F.col("rank") - F.col("before") - 1) / per_page))

    def write(key: tuple, own: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        verdict, page = key
        own = own.sort_values("index")
        files, base = afs.FileSystem.from_uri(folder)
        files.create_dir(f"{base}/{verdict}")
        texts = {n: shortcut(file_uri(p)) for n, p in zip(own["name"], own["path"], strict=True)}
        texts[page_name(page)] = _page(verdict, page, page == own["last_page"].iloc[0], own)
        for name, text in texts.items():
            with files.open_output_stream(f"{base}/{verdict}/.{name}.part") as out:
                out.write(text.encode())
            files.move(f"{base}/{verdict}/.{name}.part", f"{base}/{verdict}/{name}")
        return pd.DataFrame({"n": [len(own)]})

    paged.groupBy("verdict", "page").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    cards = "".join(f"<li>{v}: {counts[v]}</li>" if not counts[v] else f'<li><a href="{v}/index.html">{v}</a>: {counts[v]}</li>' for v in FLAGGED)
    put_text(rows.sparkSession, f"{folder.rstrip('/')}/index.html", f'<!doctype html><html lang="en"><meta charset="utf-8"><title>Review {escape(run_id)}</title><h1>Run {escape(run_id)}, policy {escape(policy)}</h1><p>Outcomes of a model, not findings of fact. No file was changed.</p><ul>{cards}</ul></html>\n')
    return counts
