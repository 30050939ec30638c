"""Main-text extraction from HTML with host suffix arrays.

Pages become blocks of text with a label: part of the article, page furniture by its
element, class or role, or neither. All words of a page are its token stream. The streams
of a host are concatenated in blocks of bounded size; a suffix array of each (prefix
doubling up to the run length) counts the pages of every repeated run, and the counts of
a host's blocks are summed. Where runs that blocks do not report could decide, a second pass
counts exactly. Runs on enough of a host's pages are its boilerplate. They
are removed and the words between them stay, unless the text looks like a mirrored one.
What is furniture by its label goes without a vote, as unique adverts and comments do.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelar.plans.cut import broadcast_if_small, materialize
from voxelar.plans.session import small_batches

from ._common import id_back, id_of, text_of
from .substring_dedup import name

#: Words of a run, and bytes of the pages in one suffix array (a longer page has one of its own).
RUN = 8
BLOCK_BYTES = 1 << 20
#: Hosts of more than one block whose sizes are broadcast.
HOST_ROWS = 200_000
#: A run is boilerplate on this part of a host's distinct pages, two at least.
SHARE = 0.1
#: In a marked article a run goes only if it is on nearly all of many distinct pages: articles of a
#: host share quotations, licences and whole passages, which the text must keep.
FIRM_SHARE, FIRM_PAGES = 0.9, 10
#: A text is taken for a mirrored one if at least half of it is covered; without a marked article,
#: if so many covered words also follow each other.
MIRROR_WORDS = 100
#: Boilerplate runs that are broadcast; beyond it the runs of pages meet those of their host by shuffle.
RUN_ROWS = 200_000

# Elements by their role in a page.
FURNITURE = set(
    "nav footer aside form script style noscript template iframe svg button select textarea dialog head menu object canvas"
    " audio video header".split()
)
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = {"br", "td", "th", "img", "wbr"}
FURNITURE_WORDS = set(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo banner"
    " cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login search comment comments disqus"
    " replies respond breadcrumb breadcrumbs share sharing social related recommended widget toolbar pagination masthead".split()
)
#: Furniture that an article or main element inside it does not end.
FIRM = set(
    "aside footer comment comments disqus replies respond related recommended ad ads advert adverts advertisement sponsored promo"
    " cookie cookies newsletter popup modal".split()
)
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
ARTICLE_WORDS = set("article articlebody content entry post story".split())

_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z0-9]+")
# A tag whose quotes hold no brackets; it ends before the next ``<``, so a failure costs no more than that far.
_PLAIN = re.compile(r"<(/?[a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")


def _labels(tag: str, attributes: str) -> tuple[int, int]:
    """How firmly an element is furniture (0 not, 1, 2) and its article level (3 article, 2 main, 1 by name, 0 none)."""
    level = 3 if tag == "article" else 2 if tag == "main" else 0
    furniture = 0 if tag not in FURNITURE else 2 if tag in FIRM else 1
    if "=" not in attributes and "hidden" not in attributes:
        return furniture, level
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            furniture = 2
        elif key == "role":
            furniture = max(furniture, int(value in FURNITURE_ROLES))
            level = max(level, 3 if value == "article" else 2 if value == "main" else 0)
        elif tag not in ("body", "html"):
            words = set(_WORD.findall(value))
            if not words.isdisjoint(FIRM):
                furniture = 2
            elif level < 2 and not words.isdisjoint(FURNITURE_WORDS):
                furniture = max(furniture, 1)
            level = max(level, int(not words.isdisjoint(ARTICLE_WORDS)))
    return furniture, level


class Scanner:
    """Markup that is no plain tag, in time linear in the page's length whatever is left open."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def tag(self, at: int) -> tuple[int, int, str, str] | None:
        """``(start, end, name, attributes)`` of the next markup from ``at``; comments and such have no name."""
        page, last = self.page, self.last[">"]
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", ""
            if start > last:
                at = page.find("<!--", start)  # only a comment can still begin
                if at < 0:
                    return None
                continue
            if page[start + 1 : start + 2] in ("!", "?"):
                return start, page.find(">", start) + 1, "", ""
            found = _NAME.match(page, start + 1)
            if found is None:
                at = start + 1
                continue
            end = self._close(found.end())
            return start, end + 1, found[0], page[found.end() : end]

    def _close(self, at: int) -> int:
        """The ``>`` that ends a tag, outside quotes that are closed before the last one."""
        page, last, first = self.page, self.last[">"], at
        while True:
            stop = _STOP.search(page, at, last + 1)
            if stop is None:
                return page.find(">", first)
            if stop[0] == ">":
                return stop.start()
            closed = page.find(stop[0], stop.end(), last) if self.last[stop[0]] > stop.start() else -1
            at = stop.end() if closed < 0 else closed + 1

    def raw_end(self, tag: str, at: int) -> int:
        """Where the content of an element that holds no markup ends, past its end tag."""
        end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(self.page, at, self.last[">"] + 1)
        return end.end() if end else len(self.page)


def blocks(page: str) -> list[tuple[str, bool, int]]:
    """Blocks ``(text, furniture, article level)`` of a page in order; broken markup is tolerated."""
    out: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    inserted: list[str] = []
    # Open elements: name, furniture, article level, whether text inside is furniture within a block,
    # and how firmly the block around is furniture.
    stack: list[tuple[str, int, int, bool, int]] = [("", 0, 0, False, 0)]
    opened: dict[str, int] = {}
    scanner = Scanner(page)

    def flush() -> None:
        for texts in (parts, inserted):
            if texts:
                text = " ".join("".join(texts).split())
                if text:
                    _, furniture, level, inline, outer = stack[-1]
                    out.append((text, texts is inserted or (outer if inline else furniture) > 0, level))
                texts.clear()

    def take(text: str) -> None:
        (inserted if stack[-1][3] else parts).append(html.unescape(text))

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    def close(tag: str) -> None:
        if not opened.get(tag):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                while len(stack) > i:
                    pop()
                return
            if tag not in BREAKS and stack[i][0] in BREAKS:
                return

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            break
        if (plain := _PLAIN.match(page, start)) is not None:
            end, raw, attributes = plain.end(), plain[1], plain[2]
        elif (found := scanner.tag(start)) is not None:
            start, end, raw, attributes = found
        else:
            break
        if start > at:
            take(page[at:start])
        at = end
        tag = raw.lstrip("/").lower()
        if not tag:
            continue
        if tag in BREAKS or tag == "head":
            flush()
        elif tag in SPACED:
            parts.append(" ")
        if raw[0] == "/":
            close(tag)
            continue
        if tag in RAW:
            at = scanner.raw_end(tag, at)
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        furniture, level = _labels(tag, attributes)
        if tag in BREAKS:
            while stack[-1][0] not in BREAKS and stack[-1][0] not in ("", "head"):
                pop()  # an inline element ends with its block
            if stack[-1][0] == "p" or tag in ("li", "tr", "dd", "dt") and stack[-1][0] == tag:
                pop()
            elif tag == "body" and stack[-1][0] == "head":
                pop()
        _, around, inside, inline, outer = stack[-1]
        if not inline:
            outer = around
        if level >= 2 and around == 1:
            around = 0  # an unclosed menu, or a form around the whole page
        if furniture == 1 and (level >= 2 or tag == "header" and inside):
            furniture = 0  # the heading of an article
        inline = inline or furniture > 0 and tag not in BREAKS and tag != "head"
        if furniture or level or tag in BREAKS or tag == "head" or inline:
            stack.append((tag, max(furniture, around), max(level, inside), inline, outer))
            opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        take(page[at:])
    flush()
    return out


_POWERS = [np.ones(1, np.uint64)]


def tokens(text: str) -> np.ndarray:
    """32-bit names of the words of a text whose words are parted by single spaces: a polynomial of their bytes."""
    if not text:
        return np.empty(0, np.uint32)
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
    space = np.flatnonzero(raw == 32)
    first = np.append(0, space + 1)
    size = np.diff(np.append(first, len(raw) + 1))
    raw[space] = 0
    if len(_POWERS[0]) < (longest := int(size.max())):
        _POWERS[0] = np.cumprod(np.append(np.uint64(1), np.full(2 * longest, 0x9E3779B97F4A7C15, np.uint64)))
    place = np.arange(len(raw)) - np.repeat(first, size)[: len(raw)]
    sums = np.add.reduceat((raw + (raw > 0)) * _POWERS[0][place], first)
    sums ^= sums >> np.uint64(31)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    return (sums >> np.uint64(32)).astype(np.uint32)


def runs_of(words: np.ndarray) -> np.ndarray:
    """Names of all runs of RUN words by doubling; index: first word."""
    n = len(words) - RUN + 1
    if n <= 0:
        return np.empty(0, np.int64)
    two = name(words[:-1].astype(np.uint64), words[1:].astype(np.uint64))
    four = name(two[:-2], two[2:])
    return name(four[:-4], four[4:]).view(np.int64)


def _streams(batches):
    """The words of every page, as names; same: a digest of its text. A task gives a text of a host once."""
    seen: set[tuple[str, int]] = set()
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            hosts, same, found = [], [], []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                text = " ".join(text for text, _, _ in blocks(page))
                key = host, xxhash.xxh64_intdigest(text)
                if key not in seen and text.count(" ") >= RUN - 1:
                    seen.add(key)
                    hosts.append(host)
                    same.append(key[1])
                    found.append(tokens(text).view(np.int32))
            columns = [pa.array(hosts, pa.string()), pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "same", "tokens"])


def suffix_groups(tokens: np.ndarray, owner: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``tokens`` to depth ``run`` and, for each entry, its group of equal prefixes.

    Tokens are less than 2**32. Suffixes that run past their page's end are left out. Ranks
    double until they stand for ``run`` tokens; equal ranks are common prefixes of at least that length.
    """
    n = len(tokens)
    rank, depth = tokens.astype(np.uint64), 1
    while depth < run:
        step = min(depth, run - depth)
        pair = rank << np.uint64(32)
        pair[: max(0, n - step)] |= rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        depth += step
    starts = np.nonzero(owner[: max(0, n - run + 1)] == owner[run - 1 :])[0]
    order = starts[np.argsort(rank[starts], kind="stable")]
    return order, rank[order]


_FOUND = "host string, run long, pages int, hides boolean"


def _search(table: pa.Table) -> pa.Table:
    """Runs of one block of a host with their number of pages, if that is two or ``SHARE`` of the block's or more.

    So a run on ``SHARE`` of all pages is reported by one block at least. ``hides``: the block leaves out
    runs that are on one of its pages. A null run counts the pages.
    """
    names, types = ["host", "run", "pages", "hides"], [pa.string(), pa.int64(), pa.int32(), pa.bool_()]
    lists = table.column("tokens").combine_chunks()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    words = lists.flatten().to_numpy().view(np.uint32)
    host = table.column("host")[0].as_py()
    least = 1 if table.column("blocks")[0].as_py() > 1 and SHARE * len(lists) <= 1 else 2
    every = pa.table([pa.array([v], t) for v, t in zip((host, None, len(lists), least > 1), types, strict=True)], names)
    if len(lists) < least:
        return every
    order, group = suffix_groups(words, owner)
    head = np.append(True, group[1:] != group[:-1])
    # Within a group the entries are in order of place, so those of one page are neighbours.
    new = head | np.append(True, owner[order][1:] != owner[order][:-1])
    first = np.nonzero(head)[0]
    pages = np.add.reduceat(new.astype(np.int32), first)
    several = pages >= least
    found = runs_of(words)[order[first[several]]]
    rows = pa.table([pa.array(c, t) for c, t in zip(([host] * len(found), found, pages[several], [least > 1] * len(found)), types, strict=True)], names)
    return pa.concat_tables([every, rows])


def _page_runs(batches):
    """The distinct runs of every page, named like those of blocks."""
    for batch in _streams(batches):
        runs = [np.unique(runs_of(t.values.to_numpy().view(np.uint32))) for t in batch.column("tokens")]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("same"), pa.array(runs, pa.list_(pa.int64()))], ["host", "same", "runs"])


def boilerplate(rows: DataFrame) -> DataFrame:
    """``(host, run, firm)``: runs on enough of the distinct pages of a host; ``rows``: ``host, html``.

    A host with more bytes than a block is dealt over several by the digest of the page's text. What
    its blocks report is a lower bound of a run's pages, and with one page for each block that hides
    it an upper one. Where a threshold lies between the two, the run is counted over all
    pages of the host, so the result is the same for any number of blocks. ``firm``: on nearly all pages.
    """
    streams = rows.mapInArrow(_streams, "host string, same long, tokens array<int>")
    sizes = rows.groupBy("host").agg(F.ceil(F.sum(F.octet_length("html")) / F.lit(float(BLOCK_BYTES))).cast("int").alias("blocks"))
    sizes = broadcast_if_small(materialize(sizes.where("blocks > 1"), "hosts"), HOST_ROWS)
    blocks_of = F.coalesce("blocks", F.lit(1))
    block = F.pmod(F.xxhash64("same"), blocks_of).cast("int")
    # One exchange: pages of a block come together, are told apart there and searched there.
    dealt = streams.join(sizes, "host", "left").select("host", block.alias("block"), blocks_of.alias("blocks"), "same", "tokens").repartition("host", "block")
    once = dealt.groupBy("host", "block", "same").agg(F.first("blocks").alias("blocks"), F.first("tokens").alias("tokens")).drop("same")
    found = materialize(once.groupBy("host", "block").applyInArrow(_search, _FOUND), "runs")
    hiding = F.sum(F.col("hides").cast("int"))
    pages = found.where("run is null").groupBy("host").agg(F.sum("pages").alias("n"), hiding.alias("blocks"))
    votes = found.where("run is not null").groupBy("host", "run").agg(F.sum("pages").alias("pages"), hiding.alias("told")).join(pages, "host")
    most = F.col("pages") + F.col("blocks") - F.col("told")
    enough = SHARE * F.col("n")
    firmly = F.greatest(FIRM_SHARE * F.col("n"), enough)
    between = [(F.col("pages") < limit) & (most >= limit) for limit in (enough, firmly)]
    votes = materialize(votes.where(most >= enough).withColumn("open", between[0] | ((F.col("n") >= FIRM_PAGES) & between[1])), "votes")
    unsure = votes.where("open").select("host", "run")
    counted = votes.where("not open").select("host", "run", "pages", "n")
    if not unsure.isEmpty():
        own = rows.join(broadcast_if_small(unsure.select("host").distinct(), HOST_ROWS), "host", "left_semi")
        own = own.mapInArrow(_page_runs, "host string, same long, runs array<long>").select("host", "same", F.explode("runs").alias("run"))
        exact = own.join(broadcast_if_small(unsure, RUN_ROWS), ["host", "run"]).groupBy("host", "run").agg(F.count_distinct("same").cast("long").alias("pages"))
        counted = counted.unionByName(exact.join(pages.select("host", "n"), "host"))
    firm = (F.col("n") >= FIRM_PAGES) & (F.col("pages") >= FIRM_SHARE * F.col("n"))
    return counted.where((F.col("pages") > 1) & (F.col("pages") >= enough)).select("host", "run", firm.alias("firm"))


def _longest(covered: np.ndarray) -> int:
    """The longest stretch of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return int((edge[1::2] - edge[::2]).max(initial=0))


def _within(at: np.ndarray, size: int) -> np.ndarray:
    """The words that runs starting at ``at`` cover."""
    edge = np.zeros(size + RUN + 1, np.int64)
    edge[at] += 1
    edge[at + RUN] -= 1
    return np.cumsum(edge)[:size] > 0


def main_text(page: str, runs: np.ndarray, firm: np.ndarray) -> tuple[str, int]:
    """The text of a page given its host's boilerplate (sorted ``runs``), and how many of all its words are boilerplate."""
    found = blocks(page)
    best = max((level for _, f, level in found if not f), default=0)
    kept = [not f and level == best for _, f, level in found]
    if not len(runs):
        return "\n".join(text for (text, _, _), k in zip(found, kept, strict=True) if k), 0
    names = runs_of(tokens(" ".join(text for text, _, _ in found)))
    place = np.minimum(np.searchsorted(runs, names), len(runs) - 1)
    hit = runs[place] == names
    edge = np.cumsum([0, *[text.count(" ") + 1 for text, _, _ in found]])
    repeated = _within(np.flatnonzero(hit), edge[-1])
    covered = _within(np.flatnonzero(hit & firm[place]), edge[-1]) if best else repeated
    inside = np.concatenate([covered[a:b] for a, b, k in zip(edge, edge[1:], kept) if k] or [np.zeros(0, bool)])
    if 2 * inside.sum() >= len(inside) and (best or _longest(inside) >= MIRROR_WORDS):
        covered = np.zeros(edge[-1], bool)
    texts = []
    for (text, _, _), a, b, k in zip(found, edge, edge[1:], kept):
        if k and covered[a:b].any():
            text = " ".join(w for w, c in zip(text.split(" "), covered[a:b].tolist(), strict=True) if not c)
        if k and text:
            texts.append(text)
    return "\n".join(texts), int(repeated.sum())


_NONE = (np.empty(0, np.int64), np.empty(0, bool))
_TEXTS = "page long, url string, text string, n_repeated long"


def _sorted(runs, firm) -> tuple[np.ndarray, np.ndarray]:
    runs, firm = np.array(runs, np.int64), np.array(firm, bool)
    order = np.argsort(runs)
    return runs[order], firm[order]


def _extracted(batch: pa.RecordBatch, lists: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    texts = [main_text(page, *found) for page, found in zip(batch.column("html").to_pylist(), lists, strict=True)]
    columns = [pa.array([t for t, _ in texts], pa.string()), pa.array([n for _, n in texts], pa.int64())]
    return pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), *columns], ["page", "url", "text", "n_repeated"])


def _texts_of_few(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Texts where all runs fit a broadcast: the pages are not moved."""
    table: dict[str, list] = {}
    for r in runs.collect():
        found = table.setdefault(r.host, ([], []))
        found[0].append(r.run)
        found[1].append(r.firm)
    known = rows.sparkSession.sparkContext.broadcast({host: _sorted(*found) for host, found in table.items()})

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield _extracted(batch, [known.value.get(h, _NONE) for h in batch.column("host").to_pylist()])

    return rows.select("page", "url", "host", "html").mapInArrow(run, _TEXTS)


def _texts_by_host(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Texts where pages and runs meet by shuffle, run by run; what gathers again are the runs of one page."""
    key = ["page", "check"]

    def own_runs(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [" ".join(text for text, _, _ in blocks(page)) for page in batch.column("html").to_pylist()]
                found = [np.unique(runs_of(tokens(t))) for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], ["page", "check", "host", "runs"])

    own = rows.select(*key, "host", "html").mapInArrow(own_runs, "page long, check long, host string, runs array<long>")
    hits = own.select(*key, "host", F.explode("runs").alias("run")).join(runs, ["host", "run"])
    lists = hits.groupBy(*key).agg(F.collect_set(F.struct("run", "firm")).alias("found"))
    both = rows.join(lists, key, "left").select("page", "url", "html", F.col("found.run").alias("runs"), F.col("found.firm").alias("firm"))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = zip(batch.column("runs").to_pylist(), batch.column("firm").to_pylist(), strict=True)
                yield _extracted(batch, [_sorted(r, f) if r else _NONE for r, f in lists])

    return both.mapInArrow(run, _TEXTS)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", search: bool = True, run_rows: int = RUN_ROWS
) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars, n_repeated``.

    ``text`` joins the kept blocks by a line feed; it is empty if nothing is kept or the
    html is null or empty. Kept are the blocks of the article if the page marks one, else
    all that no label calls furniture, without the words that boilerplate runs of the host
    cover. A text of which they cover half or more is taken for a mirrored one and stays
    whole (in a page without a marked article, only if MIRROR_WORDS covered words follow
    each other). In a marked article only runs on nearly all pages of the host go.
    ``n_repeated`` counts the words of the page in boilerplate runs, furniture included.
    Pages without a url form one host; repeated rows repeat in the result, and they and
    pages of a host with equal text are one page for the search. A null id stays null. An
    empty table gives an empty result. ``search`` False leaves the host search out.
    """
    small_batches(pages.sparkSession)
    url = F.col(f"`{url_col}`").cast("string")
    body = text_of(html_col)
    rows = pages.select(
        id_of(id_col).alias("page"),
        F.xxhash64(url, body).alias("check"),
        url.alias("url"),
        F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit("")).alias("host"),
        body.alias("html"),
    )
    if search:
        runs = materialize(boilerplate(rows.select("host", "html")), "boilerplate")
        few = runs.limit(run_rows + 1).count() <= run_rows
        texts = _texts_of_few(rows, runs) if few else _texts_by_host(rows, runs)
    else:
        texts = _texts_of_few(rows, rows.select("host", F.lit(0).cast("long").alias("run"), F.lit(False).alias("firm")).limit(0))
    return texts.select(
        id_back("page").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated"
    )
