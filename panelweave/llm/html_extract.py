"""Main text of pages by differencing each with the pages of the nearest URLs.

Pages of a host are ordered by URL path; a page's text lines are aligned with
those of the nearest page on either side that has other content, by a longest
common subsequence, and shared lines outside its article are the host's
template: they go. Markup decides about what differencing leaves: menus,
headers, footers, sidebars, notices, adverts, forms and comments go even if no
other page has them. Lines inside an article stay, whatever other pages have.

Only hashes of lines are ordered and compared; a page's html moves at most once,
to meet what was decided about it.
"""

from __future__ import annotations

import re
from functools import partial
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.plans.storage import durable

#: Names of elements.
SILENT = frozenset("script style noscript template head title iframe canvas audio video select textarea button datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Elements around a whole page, or left open before an article, so that an article inside may be the page's own.
AROUND = frozenset("form nav".split())
HEAD = frozenset("base link meta title style script noscript template".split())
CONTENT = frozenset("article main".split())
CONTAINERS = frozenset("div section ul ol dl table header figure center details".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Words of class, id and role attributes that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist respond reply replies cookie cookies consent disclaimer "
    "footer header masthead menu menubar nav navbar navigation newsletter notice notices notification alert pager pagination popup modal promo promotion promoted related recommended "
    "share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo search signup login disqus".split()
)
#: Words that may stand beside a mark in a name that is a mark as a whole.
BESIDE = frozenset("area bar block body box buttons container content group inner item items left links list outer page posts reader readers right section site stories thread threads top bottom main user users wrap wrapper".split())
#: Marks that the picture at the head of an article bears too.
PICTURE = frozenset("banner header".split())
KEEP, DROP, OPEN, UNSURE = 1, -1, 0, 2
#: Share of a page's characters from which on another page counts as a copy of it.
COPY = 0.8


def marked(value: str, but: frozenset = frozenset()) -> bool:
    """Whether one of the names of an attribute is made of marks alone, or of marks and words that go with them."""
    for name in value.lower().split():
        parts = set(re.split(r"[^a-z]+", name)) - {""}
        if parts & (MARKS - but) and parts <= MARKS | BESIDE:
            return True
    return False


class _Lines(HTMLParser):
    """(text, role) of the blocks of a page, in order.

    An article inside an element that only its name marks, inside a form or
    inside a menu that never ends is UNSURE: it counts if the page has no other.
    What cannot stand in a head ends it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int]] = []
        self.words: list[str] = []
        self.stack: list[tuple[str, int, bool]] = []  # element, role, silent
        self.unsure = 0  # number of the UNSURE article that is open, or of the last one
        self.numbers: list[int] = []
        self.menus: list[int] = []  # unsure at the start of each open nav
        self.refused: set[int] = set()  # UNSURE articles in menus that ended

    def _end_head(self) -> None:
        if self.stack and self.stack[-1][0] == "head":
            self.stack.pop()

    def _state(self) -> tuple[int, bool]:
        return self.stack[-1][1:] if self.stack else (OPEN, False)

    def _cut(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.lines.append((text, self._state()[0]))
            self.numbers.append(self.unsure)

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self._end_head()
        if tag not in INLINE:
            self._cut()
        if tag in VOID:
            return
        role, silent = self._state()
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
            role, silent = self._state()
        inside = role in (KEEP, UNSURE)
        spared = PICTURE if inside and tag == "figure" else frozenset()
        named = any(v and marked(v, spared) for k, v in attrs if k in ("class", "id", "role"))
        structural = any(name in BOILERPLATE - AROUND for name, _, _ in self.stack)
        if tag in BOILERPLATE or (tag == "header" and not inside):
            role = DROP
        elif tag in CONTENT:
            if role == DROP or named:
                role = UNSURE if not structural else DROP
                self.unsure += role == UNSURE
            elif role == OPEN:
                role = KEEP
        elif named and (tag in CONTAINERS if inside else tag not in ("body", "html")):
            role = DROP
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and re.search(r"display\s*:\s*none", v)) for k, v in attrs)
        if role != self._state()[0]:
            self._cut()
        if tag == "nav":
            self.menus.append(self.unsure)
        self.stack.append((tag, role, silent or hidden or tag in SILENT))

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag), None)
        if at is None:
            return
        # an inline end tag does not close the blocks that were left open inside it
        if tag in INLINE and any(name not in INLINE for name, _, _ in self.stack[at + 1 :]):
            return
        if tag not in INLINE or any(name not in INLINE for name, _, _ in self.stack[at:]) or self.stack[at][1] != (self.stack[at - 1][1] if at else OPEN):
            self._cut()
        if tag == "nav" and self.menus:
            self.refused.update(range(self.menus.pop() + 1, self.unsure + 1))
        del self.stack[at:]

    def handle_data(self, data):
        if not data.isspace():
            self._end_head()
        if not self._state()[1]:
            self.words.append(data)

    def finished(self) -> list[tuple[str, int]]:
        self._cut()
        sure = any(role == KEEP for _, role in self.lines)
        first = min((n for (_, role), n in zip(self.lines, self.numbers) if role == UNSURE and n not in self.refused), default=0)
        return [(t, role if role != UNSURE else KEEP if not sure and n == first else DROP) for (t, role), n in zip(self.lines, self.numbers)]


def text_lines(html: str | None) -> list[tuple[str, int]]:
    """Lines of a page with their roles; markup that ends in the middle is read as far as it goes."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    return parser.finished()


def shared_lines(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence with b (Hunt and Szymanski)."""
    where: dict[object, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least end in b of a common subsequence of each length
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in where.get(line, ()):
            lo, hi = 0, len(ends)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if ends[mid] < j else (lo, mid)
            node = (i, links[lo - 1] if lo else None)
            if lo == len(ends):
                ends.append(j)
                links.append(node)
            elif j < ends[lo]:
                ends[lo], links[lo] = j, node
    found, node = set(), links[-1] if links else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path, by pattern: no URL is invalid."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.when(host != "", host), path


def _hashed(batches):
    """Per page the hashes of its lines and their lengths."""
    for batch in batches:
        hashes, chars = [], []
        for html in batch.column(3):
            lines = text_lines(html.as_py())
            hashes.append(pd.util.hash_array(np.array([t for t, _ in lines], object)).view(np.int64) if lines else np.empty(0, np.int64))
            chars.append([len(t) for t, _ in lines])
        arrays = [*(batch.column(k) for k in range(3)), pa.array(hashes, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["host", "path", "page", "lines", "chars"])


def _differences(run: pd.DataFrame, size: int, reach: int) -> pd.DataFrame:
    """For each page of one run the places of lines that it shares with its neighbours; pages of other runs are neighbours only."""
    run = run.sort_values("rank")
    own = (run["rank"] // size == run["run"]).tolist()
    hosts, keys = run.host.tolist(), list(zip(run.host, run.path, run.page))
    lines, chars = [tuple(x) for x in run.lines], run.chars.tolist()
    known: dict[tuple, set[int] | None] = {}  # by the lines of both
    out = []

    def against(i: int, j: int) -> set[int] | None:
        """Lines of page i that page j shares; None if j is a copy of it."""
        if lines[i] == lines[j]:
            return None
        pair = lines[i], lines[j]
        if pair not in known:
            found = shared_lines(*pair)
            known[pair] = found if sum(int(chars[i][k]) for k in found) < COPY * int(sum(chars[i])) else None
        return known[pair]

    def shared(i: int, step: int) -> set[int]:
        for j in range(i + step, i + step * (reach + 1), step):
            if not 0 <= j < len(hosts) or hosts[j] != hosts[i]:
                break
            found = against(i, j)
            if found is not None:
                return found
        return set()

    for i in range(len(hosts)):
        if own[i] and lines[i]:
            gone = shared(i, -1) | shared(i, 1)
            if gone:
                out.append((*keys[i], sorted(gone)))
    return pd.DataFrame(out, columns=["host", "path", "page", "gone"])


def _texts(batches):
    """Text of each page: lines of the article, and of the others those that neither the neighbours nor the markup take away."""
    for batch in batches:
        texts, deleted = [], []
        for html, gone in zip(batch.column(2), batch.column(3).to_pylist()):
            lines, gone = text_lines(html.as_py()), set(gone or ())
            texts.append(" ".join(t for k, (t, role) in enumerate(lines) if role == KEEP or (role == OPEN and k not in gone)))
            deleted.append(sum(k in gone for k, (_, role) in enumerate(lines) if role != KEEP))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(deleted, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_deleted"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block: int = 1024, reach: int = 32) -> DataFrame:
    """(page_id, url, text, n_chars, n_deleted) per row of pages; n_deleted counts the lines that differencing took away.

    Rows of equal host, path and html are compared once. They are ordered by
    host and path; runs of ``block`` pages, with ``reach`` pages of the runs
    beside them, are compared in one task, as hashes of lines. So no task holds
    a host, and runs do not grow with the table. A neighbour that has COPY of a
    page's characters is passed over for the next; a page with only such copies
    within ``reach`` on either side is left to its markup.

    Null or empty html gives an empty text; a null or hostless
    url has no neighbour, so only markup decides; repeated rows each get their
    row; ids may be null; html of any length is read whole; other columns are
    ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    order = ["host", "path", "page"]
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"), path.alias("path"), F.xxhash64(F.col(html_col)).alias("page"))
    hashed = rows.filter("host is not null").select(*order, "html").mapInArrow(_hashed, "host string, path string, page long, lines array<long>, chars array<int>")
    # the order is written, so that ranks cannot change between their uses
    ordered = hashed.dropDuplicates(order).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = durable(ordered.withColumn("row", F.monotonically_increasing_id()), "page-lines")
    part = F.shiftright("row", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row a partition
    before, total = [], 0
    for r in counts:
        before.append((r["part"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "part long, before long"))  # one row a partition
    ranked = ordered.join(offsets, part == F.col("part")).withColumn("rank", F.col("before") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1)))
    home = lambda rank: F.floor(rank / block)
    runs = F.sequence(home(F.greatest(F.col("rank") - reach, F.lit(0))), home(F.col("rank") + reach))
    dealt = ranked.select(*order, "lines", "chars", "rank", F.explode(runs).alias("run"))
    gone = dealt.groupBy("run").applyInPandas(partial(_differences, size=block, reach=reach), "host string, path string, page long, gone array<int>")
    met = rows.join(durable(gone, "page-differences"), order, "left").select("page_id", "url", "html", "gone")
    return met.mapInArrow(_texts, "page_id long, url string, text string, n_chars long, n_deleted long")
