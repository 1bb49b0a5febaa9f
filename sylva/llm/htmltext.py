"""Main text of web pages: a suffix array over each host's pages, with block structure as a weight.

A page is parsed to blocks of text; all of them are its token stream. In shards of about SHARD pages of a host the
streams are sorted as a suffix array, which gives the runs of RUN words (and whole blocks of fewer) that distinct
pages share. A run that SHARE of the host's pages have is one that SHARE of some shard's pages have: the shards name
these, count all that were named, and the sums are the host's exact counts, however its pages are dealt.

What runs that enough pages have cover is cut out of a block; its unique runs stay, those of fewer than RUN words only if
less than half of the block is covered. Enough is a share of the host's pages, by where the block
stands: SHARE of them (2 at least) where structure says nothing (no container, outside of it, link lists and doubtful names inside it),
SURE_SHARE of them (SURE_LEAST at least) in an article, or in main on pages without one. Menus, footers, forms and what its
class, id or role names as adverts, notices or comments is compared with the rest and never kept.

Edge cases: null and empty html give the empty text; unclosed and cut-off markup ends with the page; pages of a host with the
same blocks count as one page; null urls are one host; rows that repeat are extracted each; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import itertools
import json
import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, materialize, shingles, words
from .linededup import _runs as sequence_hashes

RUN, SHARD = 8, 512
#: A run is boilerplate if this share of the host's pages have it, and so many at least; for blocks of the container after that.
SHARE, LEAST, SURE_SHARE, SURE_LEAST = 0.1, 2, 0.5, 5
#: Hosts of more than SHARD pages that may be broadcast (name and number of shards).
BROADCAST_HOSTS = 50_000
#: Runs with their counts that may be sent to all tasks (a few MB); more are joined by a shuffle.
BROADCAST_RUNS = 200_000

# Tag names of HTML by their part in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "audio", "video", "select"}
NEVER = {"nav", "aside", "footer", "form", "button", "dialog", "menu", "head"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
# Words of class and id that name what is not the article.
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promoted", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "subscription", "signup", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "related", "recommended", "recommendations", "share", "sharing", "social", "widget", "toolbar", "login", "pagination", "pager", "skip", "copyright", "legal"}
#: Elements that hold an article's own text: inside one their class and id name its subject, not a part of the page.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "caption", "figcaption", "span", "b", "i", "em", "strong", "a", "code", "label"}
# Words that only say what kind of box it is.
BOXES = {"area", "bar", "block", "body", "box", "button", "buttons", "container", "content", "div", "footer", "form", "group", "header", "heading", "holder", "inner", "item", "items", "link", "links", "list", "outer", "panel", "post", "posts", "row", "section", "slot", "text", "thread", "title", "unit", "wrap", "wrapper", "zone"}
COMMENTS = {"comment", "comments", "reply", "replies", "respond", "discussion", "disqus"}

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"']+)))?")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _named(value: str, inside: bool) -> str:
    """What a class or id says of an element: '', 'comments', 'other', or 'doubt' where it may be an article's subject.

    Inside an article one of its names must say nothing else: ad-box does, menu-history is weighed by shared runs.
    """
    names = [set(_NAME.findall(x)) for x in value.split()] if inside else [set(_NAME.findall(value))]
    why = ""
    for words_ in names:
        found = NAMES & words_
        if found and inside and words_ - NAMES - BOXES:
            why = why or "doubt"
        elif found & COMMENTS:
            return "comments"
        elif found:
            why = "other"
    return why


def _unwanted(tag: str, attrs: str, inside: bool) -> str:
    """'' if the element may hold text; else why not ('comments' or 'other'), or 'doubt'."""
    if tag in NEVER or tag == "header" and not inside:
        return "other"
    out = ""
    if attrs:
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
                return "other"
            if name in ("class", "id") and not (inside and tag in TEXT):
                why = _named(value, inside)
                if why == "comments" or why == "other" and tag not in ("body", "html", "main"):
                    return why
                out = out or (why if why == "doubt" else "")
    return out


def parse(page: str) -> list[tuple[str, int, bool]]:
    """Blocks in page order: text, container (-1 unwanted, 0 none, 1 main, 2 article), mostly links or in doubt by name."""
    blocks: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, str]] = []  # open elements with what is wrong with them
    text: list[str] = []
    unwanted: list[str] = []
    linked = [0]
    state = {"bad": 0, "doubt": 0, "article": 0, "main": 0, "a": 0}

    def flush() -> None:
        if text:
            whole = _SPACE.sub(" ", htmllib.unescape("".join(text))).strip()
            if whole:
                blocks.append((whole, 2 if state["article"] else 1 if state["main"] else 0, state["doubt"] > 0 or linked[0] * 2 > len(whole)))
            text.clear()
            linked[0] = 0
        if unwanted:
            whole = _SPACE.sub(" ", htmllib.unescape("".join(unwanted))).strip()
            if whole:
                blocks.append((whole, -1, False))
            unwanted.clear()

    def count(tag: str, why: str, step: int) -> None:
        state["bad"] += step * (why in ("comments", "other"))
        state["doubt"] += step * (why == "doubt")
        if tag in ("article", "main", "a"):
            state[tag] += step

    at = 0
    while at <= len(page):
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece and state["bad"]:
            unwanted.append(piece)
        elif piece:
            text.append(piece)
            if state["a"]:
                linked[0] += len(piece)
        if not m:
            break
        at = max(m.end(), at + 1)
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in BLOCK:
            flush()
        if closing:
            if any(t == tag for t, _ in stack):
                while True:
                    t, why = stack.pop()
                    count(t, why, -1)
                    if t == tag:
                        break
            continue
        if tag in VOID:
            continue
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if attrs.endswith("/") and tag not in BLOCK:
            continue
        # an open paragraph or list item ends where the next block begins
        if tag in BLOCK and stack and (stack[-1][0] == "p" or tag == "li" == stack[-1][0]):
            count(*stack.pop(), -1)
        why = _unwanted(tag, attrs, bool(state["article"] or state["main"]))
        if tag in ("article", "main") and why in ("", "doubt"):
            # what was left open before the article doesn't hold it, but for comments
            while stack and state["bad"] and not any(w == "comments" for _, w in stack):
                count(*stack.pop(), -1)
        stack.append((tag, why))
        count(tag, why, 1)
    flush()
    return blocks


def suffix_array(tokens: np.ndarray, depth: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, compared over depth tokens (a power of 2), and the shared length of each with the one before it."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    levels = [rank]
    steps = [1 << k for k in range(depth.bit_length())]
    for k in steps[:-1]:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:]
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        levels.append(rank)
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(n, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for size, level in zip(steps[::-1], levels[::-1], strict=True):
        ok = (a < n) & (b < n)
        ok[ok] = level[a[ok]] == level[b[ok]]
        shared[1:][ok] += size
        a[ok] += size
        b[ok] += size
    return order, shared


#: Where a block stands: never kept, in doubt, in the container.
NEVER_KEPT, DOUBT, SURE = 0, 1, 2


def _weigh(blocks: list[tuple[str, int, bool]]) -> list[tuple[str, int]]:
    """All blocks, with where they stand."""
    best = max((c for _, c, _ in blocks), default=0)
    return [(text, NEVER_KEPT if c < 0 else SURE if c == best > 0 and not links else DOUBT) for text, c, links in blocks]


def _pack(blocks: list[tuple[str, int]]) -> bytes:
    return zstandard.compress(json.dumps(blocks, ensure_ascii=False).encode("utf-8", "surrogatepass"), 6)


def _unpack(blob: bytes) -> list[list]:
    return json.loads(zstandard.decompress(blob).decode("utf-8", "surrogatepass"))


class _Words:
    """Word hashes of several pages' streams: ``w``, each block's first word ``at``, each page's first block and first word."""

    def __init__(self, pages: list[list[list]]):
        raw = [text.encode("utf-8", "surrogatepass") for page in pages for text, _ in page]
        self.w, self.at = words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        self.block = np.cumsum([0, *map(len, pages)])
        self.first = self.at[self.block]
        # runs of RUN words by start, and blocks of fewer words
        self.runs, run_at = shingles(self.w, self.first, RUN, short=False)
        self.run_page = np.repeat(np.arange(len(pages)), np.diff(run_at))
        self.run_start = np.arange(len(self.runs)) - run_at[self.run_page] + self.first[self.run_page]
        size = np.diff(self.at)
        self.few = np.flatnonzero((size > 0) & (size < RUN))
        self.whole = sequence_hashes(self.w, self.at[self.few], self.at[self.few + 1])
        self.few_page = np.searchsorted(self.block, self.few, "right") - 1


def _portions(pages: list[list[list]]):
    """(first page, hashes) of pages by portions of about a MB, which numpy works on at once."""
    a, size = 0, 0
    for k, page in enumerate(pages):
        size += sum(len(text) for text, _ in page)
        if size >= CHUNK_BYTES or k == len(pages) - 1:
            yield a, _Words(pages[a : k + 1])
            a, size = k + 1, 0


def _per_page(page: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and how many pages have each."""
    if not len(value):
        return value, np.zeros(0, np.int64)
    order = np.lexsort((page, value))
    p, v = page[order], value[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (p[1:] != p[:-1])
    v = v[new]
    head = np.ones(len(v), bool)
    head[1:] = v[1:] != v[:-1]
    at = np.flatnonzero(head)
    return v[at], np.diff(np.append(at, len(v)))


def shared_runs(pages: list[list[list]], share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs and short blocks that so many of the distinct pages have, and how many do."""
    least = max(least, math.ceil(share * len(pages) - 1e-9))
    w, size, few_page, whole, starts, names = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    done = 0  # tokens so far, with a mark after each page
    for a, x in _portions(pages):
        n = np.diff(x.first)
        w.append(x.w)
        size.append(n)
        few_page.append(x.few_page + a)
        whole.append(x.whole)
        starts.append(x.run_start + x.run_page + done)
        names.append(x.runs)
        done += len(x.w) + len(n)
    # short blocks, once for each page
    value, count = _per_page(np.concatenate(few_page), np.concatenate(whole))
    value, count = value[count >= least], count[count >= least]
    size = np.concatenate([np.zeros(0, np.int64), *size]) + 1
    n = int(size.sum())
    ends = np.cumsum(size) - 1
    t = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends] = False
    t[inside] = np.unique(np.concatenate(w), return_inverse=True)[1]
    t[ends] = -1 - np.arange(len(pages))  # no run crosses pages
    own = np.repeat(np.arange(len(pages)), size)
    name = np.zeros(n, np.uint64)
    name[np.concatenate(starts)] = np.concatenate(names)
    order, shared = suffix_array(t, RUN)
    group = np.cumsum(shared < RUN) - 1  # suffixes that share a run of RUN words stand together
    pair = np.unique(group * len(pages) + own[order])
    spread = np.bincount(pair // len(pages))
    head = order[np.flatnonzero(shared < RUN)]
    full = ends[own[head]] - head >= RUN
    take = full & (spread >= least)
    return np.concatenate([value, name[head[take]]]), np.concatenate([count, spread[take]])


def count_runs(pages: list[list[list]], want: np.ndarray) -> np.ndarray:
    """How many of the pages have each of the wanted (sorted) runs and short blocks."""
    n = np.zeros(len(want), np.int64)
    for _, x in _portions(pages):
        h, page = np.concatenate([x.runs, x.whole]), np.concatenate([x.run_page, x.few_page])
        k = np.minimum(np.searchsorted(want, h), len(want) - 1)
        hit = want[k] == h
        n += np.bincount(np.unique(page[hit] * len(want) + k[hit]) % len(want), minlength=len(want))
    return n


def unique_texts(pages: list[list[list]], runs: np.ndarray, counts: np.ndarray, total: int) -> list[str]:
    """What stays of pages of one host; runs (sorted) with the pages that have them, of the host's total."""

    def pages_of(h: np.ndarray) -> np.ndarray:
        if not len(runs):
            return np.zeros(len(h), np.int64)
        k = np.minimum(np.searchsorted(runs, h), len(runs) - 1)
        return np.where(runs[k] == h, counts[k], 0)

    enough = np.array([max(least, math.ceil(share * total - 1e-9)) for share, least in ((SHARE, LEAST), (SURE_SHARE, SURE_LEAST))])
    out = []
    for a, x in _portions(pages):
        part = pages[a : a + len(x.block) - 1]
        where = np.array([c for page in part for _, c in page], np.int64)
        least = enough[(where == SURE).astype(int)]
        start, spread = np.zeros(len(x.w), np.int64), np.zeros(len(x.w), np.int64)
        start[x.run_start] = pages_of(x.runs)
        for d in range(RUN):
            spread[d:] = np.maximum(spread[d:], start[: len(start) - d])
        covered = spread >= np.repeat(least, np.diff(x.at))
        hurt = np.diff(np.concatenate([[0], np.cumsum(covered)])[x.at]) > 0
        gone = where == NEVER_KEPT
        gone[x.few[pages_of(x.whole) >= least[x.few]]] = True
        for p, page in enumerate(part):
            kept = []
            for k, (text, _) in enumerate(page, int(x.block[p])):
                if gone[k]:
                    continue
                text = _uncovered(text, covered[x.at[k] : x.at[k + 1]]) if hurt[k] else text
                if text:
                    kept.append(text)
            out.append("\n".join(kept))
    return out


def _uncovered(text: str, covered: np.ndarray) -> str:
    """The unique runs of a block."""
    parts, size = text.split(" "), 1 if 2 * int(covered.sum()) < len(covered) else RUN
    edge = np.flatnonzero(np.diff(np.concatenate([[True], covered, [True]]).astype(np.int8)))
    return " ".join(" ".join(parts[a:b]) for a, b in edge.reshape(-1, 2).tolist() if b - a >= size)


def _distinct(blobs: pa.ChunkedArray) -> list[list[list]]:
    return [_unpack(b) for b in dict.fromkeys(blobs.to_pylist())]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    # only hosts of several shards are looked up: broadcast while they are few, else joined by a shuffle
    large = rows.groupBy("host").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards")).where("shards > 1")
    found = large.limit(BROADCAST_HOSTS + 1).count()

    def read(batches):
        for batch in batches:
            blobs = [_pack(_weigh(parse(x.as_py() or ""))) for x in batch.column("html")]
            digest = [int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True) for b in blobs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host", "shards")), pa.array(digest, pa.int64()), pa.array(blobs, pa.binary())], names=["page_id", "url", "host", "shards", "digest", "blob"])

    def once(batches):
        # a task leaves out blocks that it has seen on the host
        seen = set()
        for batch in batches:
            keys = zip(batch.column("host").to_pylist(), batch.column("digest").to_pylist(), strict=True)
            yield batch.filter(pa.array([not (k in seen or seen.add(k)) for k in keys], pa.bool_()))

    rows = rows.join(F.broadcast(large) if found <= BROADCAST_HOSTS else large, "host", "left")
    rows = rows.select("page_id", "url", "host", F.coalesce("shards", F.lit(1)).alias("shards"), "html")
    parsed = materialize(rows.mapInArrow(read, "page_id long, url string, host string, shards int, digest long, blob binary"))
    distinct = parsed.select("host", "shards", "digest", "blob").mapInArrow(once, "host string, shards int, digest long, blob binary")

    def dealt(df: DataFrame, by) -> DataFrame:
        # one column to group by, so that a host's shards are dealt apart
        return df.withColumn("bin", F.concat_ws(" ", by.cast("string"), "host"))

    def to_all(df: DataFrame) -> DataFrame:
        return dealt(df.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))), F.col("k"))

    # equal blocks meet in one shard
    by_content = F.pmod("digest", "shards")

    def name(table: pa.Table) -> pa.Table:
        pages, shards = _distinct(table.column("blob")), table.column("shards")[0].as_py()
        runs, n = shared_runs(pages, SHARE, LEAST if shards == 1 else 1)
        size = len(runs) + 1
        run = pa.concat_arrays([pa.array([None], pa.int64()), _signed(runs)])  # the first row has the number of pages
        return pa.table({"host": pa.array([table.column("host")[0].as_py()] * size, pa.string()), "shards": pa.array([shards] * size, pa.int32()), "run": run, "n": pa.array([len(pages), *n.tolist()], pa.int64())})

    named = materialize(dealt(distinct, by_content).select("bin", "host", "shards", "blob").groupBy("bin").applyInArrow(name, "host string, shards int, run long, n long"))
    total = named.where("run is null").groupBy("host").agg(F.sum("n").alias("total"))
    runs = named.where("run is not null and shards = 1").select("host", "shards", "run", "n")
    if found:

        def count(pages: pa.Table, wanted: pa.Table) -> pa.Table:
            none = pa.table({"host": pa.array([], pa.string()), "shards": pa.array([], pa.int32()), "run": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
            if not len(pages) or not len(wanted):
                return none
            want = np.sort(wanted.column("run").to_numpy().view(np.uint64))
            n = count_runs(_distinct(pages.column("blob")), want)
            has = n > 0
            size = int(has.sum())
            return pa.table({"host": pa.array([pages.column("host")[0].as_py()] * size, pa.string()), "shards": pa.array([pages.column("shards")[0].as_py()] * size, pa.int32()), "run": _signed(want[has]), "n": pa.array(n[has])})

        wanted = to_all(named.where("run is not null and shards > 1").select("host", "shards", "run").distinct()).select("bin", "run")
        many = dealt(distinct.where("shards > 1"), by_content).select("bin", "host", "shards", "blob")
        exact = many.groupBy("bin").cogroup(wanted.groupBy("bin")).applyInArrow(count, "host string, shards int, run long, n long")
        runs = runs.unionByName(exact.groupBy("host", "shards", "run").agg(F.sum("n").alias("n")))
    flagged = runs.join(total, "host").where(f"n >= greatest({LEAST}, ceil({SHARE}D * total - 1e-9D))")
    flagged = materialize(flagged.select("host", "shards", "total", "run", "n"))
    fields = "page_id long, url string, text string, n_chars long"

    def result(pages, texts: list[str]) -> dict:
        return {"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    def sorted_runs(run: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(run.view(np.uint64))
        return run.view(np.uint64)[order], n[order]

    if flagged.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS:
        # few enough for every task: pages stay where they are
        rows = flagged.toArrow().sort_by("host")  # sorted once, then cut where the host changes
        names = rows.column("host").to_pylist()
        cuts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
        run, n, total = (rows.column(c).to_numpy() for c in ("run", "n", "total"))
        hosts = {names[i]: (*sorted_runs(run[i:j], n[i:j]), int(total[i])) for i, j in itertools.pairwise([*cuts, len(names)])}
        known = pages.sparkSession.sparkContext.broadcast(hosts)
        nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)

        def clean_batch(batches):
            for batch in batches:
                texts: list[str | None] = [None] * len(batch)
                by: dict[str, list[int]] = {}
                for k, h in enumerate(batch.column("host").to_pylist()):
                    by.setdefault(h if h in known.value else None, []).append(k)
                blob = batch.column("blob")
                for h, at in by.items():
                    for k, text in zip(at, unique_texts([_unpack(blob[k].as_py()) for k in at], *known.value.get(h, nothing)), strict=True):
                        texts[k] = text
                yield pa.RecordBatch.from_pydict(result(batch, texts))

        return parsed.select("page_id", "url", "host", "blob").mapInArrow(clean_batch, fields)

    def clean(pages: pa.Table, found: pa.Table) -> pa.Table:
        run, n, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 1
        if len(found):
            run, n = sorted_runs(np.array(found.column("run")[0].as_py(), np.int64), np.array(found.column("n")[0].as_py(), np.int64))
            total = found.column("total")[0].as_py()
        return pa.table(result(pages, unique_texts([_unpack(b.as_py()) for b in pages.column("blob")], run, n, total)))

    grouped = flagged.groupBy("host", "shards", "total").agg(F.collect_list("run").alias("run"), F.collect_list("n").alias("n"))
    every = dealt(parsed, F.pmod(F.xxhash64("page_id", "url"), "shards")).select("bin", "page_id", "url", "blob")
    lists = to_all(grouped).select("bin", "run", "n", "total")
    return every.groupBy("bin").cogroup(lists.groupBy("bin")).applyInArrow(clean, fields)
