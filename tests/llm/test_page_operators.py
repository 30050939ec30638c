"""Pages, archives and binary output: against brute force, round trips and edge cases."""

import glob
import gzip
import hashlib
import os
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxelar.llm import bpe, html_extract, token_output, warc
from voxelar.llm._common import vocabulary

PAGES = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("digest", F.lit("clash"))


# --- HTML extraction


def shell(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


CASES = [
    (shell("<nav><ul><li>Home</li></ul></nav><div class='ad'>Buy</div><article><h1>A&amp;B</h1><p>x <b>y</b>z<br>w</p></article><footer>f</footer>"), "A&B\nx yz w"),
    (shell("<article><p>One<p>Two<ul><li>a<li>b</ul></article>", "<script>var t='</p>';</script><style>p{}</style>"), "One\nTwo\na\nb"),
    (shell("<main><header><h1>H</h1></header><p>t&nbsp;u &lt;v&gt; &#233;</p><aside>s</aside><form>f<input></form></main><section id='comments'><article>c</article></section>"), "H\nt u <v> é"),
    ("<article>never closed <b>bold <p>next", "never closed bold\nnext"),
    ("<!-- <article>no</article> --><article>yes<!-- no -->!</article>", "yes!"),
    ("<nav>menu <article>still found</article>", "still found"),
    ("<form><article>in a form</article></form>", "in a form"),
    ("<article>a <span class='advert'>buy</span> b<div class='cookie-notice'>c <b>d</b></div><div class='comments'><p>e</p></div></article>", "a b"),
    ("<div id=content><p>by name</p></div><div class='sidebar'>s</div>", "by name"),
    ("<p>no marks</p><div role='navigation'>n</div><p>at all", "no marks\nat all"),
    ("plain text", "plain text"),
    ("<article></article>", ""),
    ("", ""),
    (None, ""),
    ("<article title='a > b'><p attr=\"</article>\">q</p></article>", "q"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
]


def test_texts_of_pages(spark):
    rows = [(i, f"http://h{i}.example/x", h) for i, (h, _) in enumerate(CASES)]
    got = {r.page_id: (r.text, r.n_chars, r.url) for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got == {i: (t, len(t), f"http://h{i}.example/x") for i, (_, t) in enumerate(CASES)}


def generated_hosts(rng):
    """Pages with and without marks, menus, notices inside articles, mirrors, quotations and adverts of their own."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for host, size in (("one.example", 1), ("two.example", 2), ("small.example", 7), ("large.example", 30)):
        menu = "<div>" + "</div><div>".join(text(1) for _ in range(12)) + "</div>"
        legal, notice, quote, mirror = text(14), text(11), text(15), text(160)
        for i in range(size):
            own = [text(rng.randint(5, 40)) for _ in range(rng.randint(1, 4))]
            if i % 5 == 1:
                own[0] += " " + quote
            if i % 7 == 2:
                own = [mirror, text(3)]
            inner = "".join(f"<p>{p}</p>" for p in own)
            if i % 2:
                body = f"{menu}<article><h1>{text(4)}</h1>{inner}<p>{notice}</p></article><div>{legal}</div>"
            else:
                body = f"{menu}<div class=ad>{text(9)}</div>{inner}<p>{text(3)} {notice}</p><div>{legal} {i}</div>"
            rows.append((len(rows), f"http://{host}/{i}", body if host != "large.example" or i % 2 else body.replace(notice, text(11))))
    notice = text(11)
    rows += [(len(rows) + i, f"http://firm.example/{i}", f"<article><p>{text(30)} {notice}</p></article><p>{text(9)}") for i in range(12)]
    rows += [(None, "http://small.example/9", rows[2][2]), rows[5], (900, None, rows[9][2]), (901, "http://small.example", None)]
    return rows


def texts_by_hand(rows):
    """The rules of ``extract`` over tuples of words."""
    n = html_extract.RUN
    pages, hosts = [], {}
    for _, url, page in rows:
        host = url.split("/")[2] if url else ""
        found = html_extract.blocks(page or "")
        words = tuple(w for text, _, _ in found for w in text.split())
        pages.append((host, found, words))
        if len(words) >= n:
            hosts.setdefault(host, set()).add(words)
    on_pages = {h: Counter(run for w in distinct for run in {w[i : i + n] for i in range(len(w) - n + 1)}) for h, distinct in hosts.items()}
    out = []
    for host, found, words in pages:
        distinct = hosts.get(host, set())
        votes = lambda run: on_pages[host][run]  # noqa: B023, E731
        best = max((level for _, f, level in found if not f), default=0)
        all_hit, hit = [False] * len(words), [False] * len(words)
        for i in range(len(words) - n + 1):
            v = votes(words[i : i + n])
            if v >= 2 and v >= 0.1 * len(distinct):
                all_hit[i : i + n] = [True] * n
            if v >= 2 and v >= (max(10, 0.9 * len(distinct)) if best else 0.1 * len(distinct)):
                hit[i : i + n] = [True] * n
        at, blocks = 0, []
        for text, f, level in found:
            size = len(text.split())
            if not f and level == best:
                blocks.append((text, hit[at : at + size]))
            at += size
        flat = [h for _, b in blocks for h in b]
        longest = max((len(x) for x in "".join("x" if h else " " for h in flat).split()), default=0)
        if 2 * sum(flat) >= len(flat) and (best or longest >= 100):
            kept = [t for t, _ in blocks]
        else:
            kept = [" ".join(w for w, h in zip(t.split(), b, strict=True) if not h) for t, b in blocks]
        out.append(("\n".join(k for k in kept if k), sum(all_hit)))
    return out


def test_extraction_by_hand_on_generated_hosts(spark):
    rows = generated_hosts(random.Random(5))
    want = sorted((str(i), u or "", t, n) for (i, u, _), (t, n) in zip(rows, texts_by_hand(rows), strict=True))
    for run_rows in (html_extract.RUN_ROWS, 0):
        got = html_extract.extract(pages(spark, rows), run_rows=run_rows).collect()
        assert sorted((str(r.page_id), r.url or "", r.text, r.n_repeated) for r in got) == want
    off = {(str(r.page_id), r.text) for r in html_extract.extract(pages(spark, rows), search=False).collect()}
    changed = [r for r in want if (r[0], r[2]) not in off]
    # The search decides texts of pages with and without a marked article.
    assert len(changed) > 20 and any("firm" in r[1] for r in changed)
    mirrors = [r for r in want if len(r[2].split()) >= 160]
    assert len(mirrors) >= 5


def test_blocks_of_a_host_find_what_one_does(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    menu = text(20)
    rows = [(i, "http://big.example/", f"<p>{menu}</p><p>{text(30)}</p>") for i in range(120)]
    found = []
    for size in (1 << 20, 10_000):
        monkeypatch.setattr(html_extract, "BLOCK_BYTES", size)
        found.append(sorted(map(str, html_extract.extract(pages(spark, rows)).collect())))
    assert found[0] == found[1] and menu.split()[0] not in found[0][0]


def test_runs_are_counted_exactly_whatever_the_number_of_blocks(spark, monkeypatch):
    """Runs on 8, 10, 12, 20, 89 and 90 % of a host's pages: one block and some fifty of a few pages decide alike."""
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    shares = (8, 10, 12, 20, 89, 90)
    notes = {share: text(12) for share in shares}
    rows = []
    for i in range(200):
        own = [f"<p>{notes[share]}</p>" for share in shares if (i * 37 + share) % 200 < 2 * share]
        inner = f"<p>{text(150)}</p>{''.join(own)}"
        rows.append((i, "http://big.example/", f"<article>{inner}</article>" if i % 2 else inner))
    want = sorted((str(i), u, t, n) for (i, u, _), (t, n) in zip(rows, texts_by_hand(rows), strict=True))
    kept = " ".join(t for _, _, t, _ in want)
    assert kept.count(notes[8].split()[0]) == 16 and 0 < kept.count(notes[12].split()[0]) < 24 and notes[90].split()[0] not in kept
    for size, run_rows in ((1 << 20, 1000), (5_000, 1000), (5_000, 0), (2_000, 1000)):
        monkeypatch.setattr(html_extract, "BLOCK_BYTES", size)
        got = html_extract.extract(pages(spark, rows), run_rows=run_rows).collect()
        assert sorted((str(r.page_id), r.url, r.text, r.n_repeated) for r in got) == want


@pytest.mark.parametrize("page", ["<a " * 1_700_000, '<a "' * 1_200_000 + ">", "<div>" * 300_000 + "</section>x" * 300_000, "<script>" + "</script " * 500_000, "<span class=ad>" * 100_000 + "x</p>" * 400_000, "<!--" * 1_200_000, "<" * 5_000_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    html_extract.main_text(page, *html_extract._NONE)
    assert time.process_time() - began < 5


def test_repeated_runs_of_a_host_go(spark):
    menu = "<div>" + "</div><div>".join("Home News Sport Weather Travel Money Shop About us".split()) + "</div>"
    foot = "<div>All rights reserved by the owners of this fine site</div>"
    own = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(9)]
    rows = [(i, "https://user@Site.example:80/a", f"{menu}<p>{own[i]}</p>{foot}") for i in range(9)]
    rows += [(20, "https://other.example/a", f"{menu}<p>alone</p>"), (21, None, f"{menu}<p>null</p>"), (None, "https://site.example/b", f"<article>kept</article>{foot}")]
    got = {r.page_id: r for r in html_extract.extract(pages(spark, rows)).collect()}
    assert all(got[i].text == own[i] and got[i].n_repeated == 19 for i in range(9))
    assert got[20].text.endswith("alone") and got[20].text.startswith("Home\n") and got[21].n_repeated == 0
    assert (got[None].text, got[None].n_repeated) == ("kept", 10)


def test_repeated_rows_are_one_page(spark):
    row = (1, "http://a.example", "<p>" + " ".join(f"w{i}" for i in range(20)) + "</p>")
    got = html_extract.extract(pages(spark, [row, row])).collect()
    assert [r.n_repeated for r in got] == [0, 0] and got[0].n_chars > 0
    assert html_extract.extract(pages(spark, [row]).limit(0)).count() == 0


def test_captures_of_one_page_keep_their_text(spark):
    foot = "<div>All rights reserved by the owners of this fine site</div>"
    own = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(2)]
    rows = [(i, f"http://a.example/{i}", f"<p>{own[0]}</p>{foot}") for i in range(3)] + [(3, "http://a.example/3", f"<p>{own[1]}</p>{foot}")]
    rows += [(i, "http://b.example", f"<p>{own[0]}</p>{foot}") for i in (4, 5)]
    rows += [(i, "http://c.example", f"<article>{i}</article>{foot}") for i in (6, 7)]  # equal but for the article
    got = {r.page_id: (r.text, r.n_repeated) for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got[0] == got[1] == got[2] == (own[0], 10) and got[3] == (own[1], 10)
    assert got[4] == got[5] and got[4][0].startswith(own[0]) and got[4][1] == 0
    assert got[6] == ("6", 10) and got[7] == ("7", 10)


def test_suffix_groups_by_hand():
    rng = np.random.default_rng(0)
    owner = np.repeat(np.arange(6), 50)
    tokens = rng.integers(0, 2, len(owner)).astype(np.uint64)
    order, group = html_extract.suffix_groups(tokens, owner, 5)
    starts = [i for i in range(len(tokens) - 4) if owner[i] == owner[i + 4]]
    assert sorted(order) == starts
    seen = {}
    for i, g in zip(order, group, strict=True):
        assert seen.setdefault(tuple(tokens[i : i + 5]), g) == g
    assert len(set(seen.values())) == len(seen) and (np.diff(group) >= 0).all()


# --- WARC


def test_archives_round_trip(spark):
    big, same = "<p>é🙂\r\n\r\nWARC/1.1\r\n</p>" * 50, "x" * 100
    rows = [(3, "http://a/\r\nInjected: 1", big), (1, "http://b", same), (2, None, same), (7, "http://c", same), (4, "http://d", "x" * 99), (5, "http://d", "x" * 99)]
    rows += [(6, "", None), (8, "http://e", ""), (None, "http://n", "n" * 200), (9, "http://n", "n" * 200), (10, "http://r", same), (10, "http://r", same)]
    got = sorted(map(tuple, warc.round_trip(pages(spark, rows)).collect()), key=str)
    first = {}
    for i, _, h in rows:
        key = -1 if i is None else i
        first[h] = min(first.get(h, key), key)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and (-1 if i is None else i) != first[h]
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", (None if first[h] == -1 else first[h]) if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages(spark, rows).limit(0)).count() == 0


def test_captures_are_nested(spark, tmp_path):
    warc.write_archives(pages(spark, [(1, "http://a/x", "<p>1</p>"), (2, "http://b", "z" * 3_000_000)]), f"{tmp_path}/w")
    found = warc.assemble(warc.read_archives(spark, f"{tmp_path}/w"))
    rows = {r.response.uri: r for r in found.collect()}
    assert bytes(rows["http://a/x"].response.block).endswith(b"\r\n\r\n<p>1</p>")
    assert bytes(rows["http://a/x"].request.block) == b"GET /x HTTP/1.1\r\nHost: a\r\n\r\n"
    assert rows["http://b"].response.payload_bytes == 3_000_000 and rows["http://b"].metadata.block


def test_archives_hold_one_member_per_record_in_bounded_files(spark, tmp_path):
    rows = [(i, f"http://h/{i} é\n", f"<p>{i}</p>" + "y" * 5000) for i in range(40)] + [(40, "odd:x", "z" * 100_000), (41, None, "")]
    listed = warc.write_archives(pages(spark, rows).coalesce(2), f"{tmp_path}/w", most=60_000).collect()
    files = sorted(os.path.basename(f) for f in glob.glob(f"{tmp_path}/w/*"))
    assert files == sorted(r.file for r in listed) and len(files) >= 4 and all(f.endswith(".warc.gz") for f in files)
    assert sum(r.records for r in listed) == 3 * 42 and all(r.bytes < 60_000 + 110_000 for r in listed)
    for f in files:
        data, members, offsets = open(f"{tmp_path}/w/{f}", "rb").read(), [], [0]
        while offsets[-1] < len(data):
            unpack = zlib.decompressobj(31)
            members.append(unpack.decompress(data[offsets[-1] :]))
            offsets.append(len(data) - len(unpack.unused_data))
        assert all(len(list(warc.parse(m))) == 1 for m in members) and b"WARC-Type: warcinfo" in members[0]
        # Random access: any member can be read on its own.
        assert list(warc.parse(data[offsets[3] :]))[0] == list(warc.parse(members[3]))[0]
    before = {f: open(f"{tmp_path}/w/{f}", "rb").read() for f in files}
    warc.write_archives(pages(spark, rows).coalesce(2), f"{tmp_path}/w", most=60_000)  # a second attempt
    assert {f: open(f"{tmp_path}/w/{f}", "rb").read() for f in files} == before
    assert len(warc.assemble(warc.read_archives(spark, f"{tmp_path}/w")).collect()) == 42


def test_hot_payloads_are_not_one_task(spark, monkeypatch):
    """A third of all pages share one payload: neither their digest nor their response is a shuffle key."""
    rows = [(i, "http://a", "same " * 40 if i % 3 == 0 else f"own {i} " * 30) for i in range(3000)]
    seen = warc.materialize(warc.captures(pages(spark, rows)), "captures")
    plan = warc.revisits(seen)
    sizes = [r.n for r in plan.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 999 and max(sizes) < 700
    got = warc.round_trip(pages(spark, rows))
    assert got.where("record_type = 'revisit' and refers_to = 0 and payload_bytes = 200").count() == 999
    monkeypatch.setattr(warc, "ROW_IDS", 0)
    assert got.exceptAll(warc.round_trip(pages(spark, rows))).count() == 0


def test_one_scan_reads_the_archives(spark, tmp_path):
    warc.write_archives(pages(spark, [(1, "http://a", "x")]), f"{tmp_path}/w")
    plan = warc.assemble(warc.read_archives(spark, f"{tmp_path}/w"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan binaryFile") + plan.count("BatchScan") == 1 and plan.count("Join") == 0


def record(kind, block, **headers):
    lines = [f"WARC-Type: {kind}", *[f"{k.replace('_', '-')}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Members per record, plain files, records without partners, empty and cut files."""
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    parts = [record("warcinfo", b""), record("response", http, WARC_Record_ID="<a>", Content_Type="application/http")]
    parts.append(record("request", b"GET /", WARC_Record_ID="<b>", WARC_Concurrent_To="<lost>"))
    (tmp_path / "a").mkdir()
    (tmp_path / "a/m.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "a/p.warc").write_bytes(b"".join(parts).replace(b"<a>", b"<c>"))
    (tmp_path / "a/e.warc").write_bytes(b"")
    found = warc.read_archives(spark, str(tmp_path / "a"))
    assert found.count() == 6
    lost = record("revisit", http, WARC_Record_ID="<r>", WARC_Refers_To="<gone>", WARC_Payload_Digest="sha256:ab", Content_Type="application/http")
    (tmp_path / "b").mkdir()
    (tmp_path / "b/r.warc").write_bytes(lost)
    assert [tuple(r) for r in warc.resolved(warc.read_archives(spark, str(tmp_path / "b"))).collect()] == [(None, None, "ab", "revisit", None)]
    got = warc.assemble(found).collect()
    assert sorted((r.capture, r.response.payload_bytes, r.request) for r in got) == [("<a>", 4, None), ("<c>", 4, None)]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(parts[1][:-8]))


# --- training order


@pytest.mark.parametrize("total", [1, 2, 3, 17, 1000, 4097])
def test_feistel_permutes(total):
    got = token_output.feistel(np.arange(total), total)
    assert sorted(got) == list(range(total))
    assert total < 17 or (got != token_output.feistel(np.arange(total), total, key=1)).any()


def slots_by_hand(paths, length, key=token_output.KEY):
    """The slot table from the files alone: rows in file order, ranked and permuted one by one."""
    enc = bpe.encoding(vocabulary(bpe.RANKS))
    pieces = []
    for path in sorted(paths):
        for row in pq.read_table(path).to_pylist():
            ids = [*enc.encode_ordinary(row["text"] or ""), token_output.SEPARATOR]
            for k in range(-(-len(ids) // length)):
                part = ids[k * length : (k + 1) * length]
                pieces.append((row["doc_id"], k, len(part), part + [token_output.SEPARATOR] * (length - len(part))))
    total = len(pieces)
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    table = {}
    for rank, piece in enumerate(pieces):
        slot = rank
        while True:
            left, right = slot >> half, slot & ((1 << half) - 1)
            for r in range(token_output.ROUNDS):
                f = (right + key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64
                f = ((f ^ f >> 30) * 0xBF58476D1CE4E5B9) % 2**64
                f = ((f ^ f >> 27) * 0x94D049BB133111EB) % 2**64
                left, right = right, left ^ ((f ^ f >> 31) & ((1 << half) - 1))
            slot = left << half | right
            if slot < total:
                break
        table[slot] = piece
    return table


def documents(spark, folder, files=3):
    rng = random.Random(1)
    texts = [None, "", "one two", " lead  and\n gaps ", "same", "same", "x" * 70_000] + [" ".join(rng.choice(["alpha", "béta", "gam-ma.", "\n"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, None), (5, "same")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash")).repartition(files).write.parquet(folder)
    return spark.read.parquet(folder)


def read_back(spark, folder, **span):
    return {r.slot: (r.doc, r.part, r.n_ids, np.frombuffer(bytes(r.ids), np.uint16).tolist()) for r in token_output.read_shards(spark, folder, **span).collect()}


def test_slots_are_those_of_the_table_by_hand(spark, tmp_path):
    scan = documents(spark, f"{tmp_path}/docs")
    want = slots_by_hand(glob.glob(f"{tmp_path}/docs/*.parquet"), 16)
    out = f"file://{tmp_path}/out"
    shards = token_output.write_shards(scan, out, length=16, records=100).collect()
    assert read_back(spark, out) == want
    full, rest = divmod(len(want), 100)
    assert {r.shard: r.records for r in shards} == {i: 100 for i in range(full)} | ({full: rest} if rest else {})
    for i in range(full):  # a slot's file and offset are a division
        assert os.path.getsize(f"{tmp_path}/out/{i:08d}.bin") == 100 * 32 and os.path.getsize(f"{tmp_path}/out/{i:08d}.idx") == 100 * 16
    assert read_back(spark, out, start=150, stop=333) == {s: want[s] for s in range(150, 333)}
    assert read_back(spark, out, start=len(want)) == {}


def test_slots_of_the_shuffled_join(spark, tmp_path):
    """With too many splits to broadcast, rows reach a task by shuffle, spill and are put in order again."""
    scan = documents(spark, f"{tmp_path}/docs")
    want = slots_by_hand(glob.glob(f"{tmp_path}/docs/*.parquet"), 16)
    spill = "spark.sql.sortMergeJoinExec.buffer.spill.threshold"
    spark.conf.set(spill, "5")
    token_output.write_shards(scan, f"file://{tmp_path}/out", length=16, records=100, split_rows=0)
    spark.conf.unset(spill)
    assert read_back(spark, f"file://{tmp_path}/out") == want


def test_retried_tasks_write_the_same_shards(spark, tmp_path):
    scan = documents(spark, f"{tmp_path}/docs")
    out = f"file://{tmp_path}/out"
    token_output.write_shards(scan, out, length=16, records=100)
    before = {f: open(f, "rb").read() for f in glob.glob(f"{tmp_path}/out/*.*")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    token_output.write_shards(scan, out, length=16, records=100)  # over the files of the first attempt
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {f: open(f, "rb").read() for f in glob.glob(f"{tmp_path}/out/*.*")} == before
    # A task that hands its rows over out of order is refused, not written.
    batch = pa.RecordBatch.from_pydict({"split": [1, 1], "base": [0, 0], "row": [1, 0], "doc": [1, 2], "text": ["a", "b"]})
    with pytest.raises(ValueError, match="out of order"):
        list(token_output._sequences(vocabulary(bpe.RANKS), 16, 2, 1)(iter([batch])))


def test_order_does_not_depend_on_splits(spark, tmp_path):
    rows = [(i, "word " * (i % 70)) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/docs")
    found = []
    for size in ("128m", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        scan = spark.read.parquet(f"{tmp_path}/docs")
        token_output.write_shards(scan, f"file://{tmp_path}/{size}", length=16, records=512)
        found.append(read_back(spark, f"file://{tmp_path}/{size}"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0] == found[1] == slots_by_hand(glob.glob(f"{tmp_path}/docs/*.parquet"), 16)


def test_order_of_no_scan_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b c"), (None, "d")], "doc_id long, text string").withColumn("doc", F.lit("clash"))
    got = token_output.materialised_order(df).collect()
    assert sorted(r.slot for r in got) == [0, 1] and {r.doc_id for r in got} == {1, None}
    assert token_output.materialised_order(df.limit(0)).count() == 0
