"""Operators 11 to 13: fill-in-the-middle, repair of conversations, web archives."""

import base64
import gzip
import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from wayloom.llm import archives, conversations, entry, fim

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

# --- 11: fill-in-the-middle -------------------------------------------------------------------


def arranged(doc_id, text):
    text, h = text or "", sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    return len(text), *(("spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}"))


def test_arrangements_match_brute_force_and_are_restored(spark):
    rng = random.Random(3)
    alphabet = ["a", "é", "𝄞", "\n", "\r", " ", "<", "P>", "<S", ">", "M", "\U0001f926‍", " ", "\x00"]
    texts = [None, "", "<P>", "x<M>y", "a", "long " * 40_000] + ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(400)]
    rows = list(enumerate(texts)) + [(None, "no id"), (7, texts[7])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    made = fim.arrange(docs)
    got = made.select("*", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted(map(repr, [(r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in got])) == sorted(map(repr, [(i, *arranged(i, t)) for i, t in rows]))
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.arrange(docs.limit(0)).count() == 0


def test_sentinels_must_be_told_apart(spark):
    for bad in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<<P>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.arrange(spark.createDataFrame([(1, "x")], "doc_id long, text string"), sentinels=bad)


# --- 12: conversations ------------------------------------------------------------------------


def repaired(rows):
    """Cost, edits and rows of the cheapest repair, by trying edits in order of cost and then of their initials."""
    heap, tie = [(0, "", 0, "", ())], 0
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and (not roles or roles[-1] == "a"):
            return cost, audit, list(out)
        can = {"": "su", "s": "u", "u": "a", "a": "u"}[roles[-1:]]
        new = "assistant" if can == "a" else "user"
        if audit[-2:] != "II":
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + new[0], (*out, f"{new}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, out))
            if fault not in ("b", "d"):
                more = 3 * (fault == "t")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + new[0], (*out, f"{new}:{text}")))
                if role[:1] in can and role:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*out, f"{role}:{text}")))
    raise AssertionError


def report(rows):
    """The report of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faulty = set(), []
    for _, role, text in rows:
        solid = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        faulty.append((role, text, "b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else ""))
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
    cost, audit, out = repaired(faulty)
    return gaps, *(sum(f[2] == k for f in faulty) for k in "bdt"), illegal, cost, audit, out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def test_conversations_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"]), rng.choice(["Yes.", "No!", "why", " \n", "", None, "Ends. ", "So?\t"])) for c in range(150) for _ in range(rng.randrange(1, 7))]
    rows += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Well."), (-4, 2, "user", "Same."), (-4, 2, "user", "Same."), (-4, None, None, None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    repair = conversations.Repair(conversations.damage(table), F.col("copies"))
    got = {r.conv_id: tuple(r)[1:] for r in repair.digests().collect()}
    turns = {}
    for r in repair.turns().orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        *wanted, out = report([r[1:] for r in after if r[0] == conv])
        assert got.pop(conv) == (*wanted, sha("\n".join(out)))
        assert turns.get(conv, []) == out
    assert not got
    assert conversations.Repair(conversations.damage(table.limit(0)), F.col("copies")).digests().count() == 0


def test_conversation_without_rows_left(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 0), (1, 1, "user", "Hi.", 0)], "conv_id long, turn long, role string, text string, copies int")
    assert [tuple(r) for r in conversations.Repair(rows, F.col("copies")).digests().collect()] == [(1, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_layers_of_a_shared_prefix_are_made_once(monkeypatch):
    made = []
    first = conversations.Layer.__init__
    monkeypatch.setattr(conversations.Layer, "__init__", lambda self, letter, after: (made.append(letter), first(self, letter, after))[1])
    signatures = sorted("".join(x) for x in [("a", "u") * 9, ("a", "u") * 8, ("a", "u") * 8 + ("s",), ("a", "U")])
    got = list(conversations.answers(signatures))
    assert len(made) == 1 + len({s[:i] for s in signatures for i in range(1, len(s) + 1)})
    assert got == [(s, *conversations.answer(path_of(s), s)) for s in signatures]


def path_of(signature):
    path = [conversations.Layer(None, None)]
    for letter in signature:
        path.append(conversations.Layer(letter, path[-1]))
    return path


def test_long_conversation_and_salted_answers(spark, monkeypatch):
    long = [(1, i, "assistant" if i % 2 else "user", f"Row {i}.") for i in range(30_000)]
    same = [(c, i, "user", f"{i}.") for c in range(2, 200) for i in range(3)]
    rows = spark.createDataFrame(long + same, "conv_id long, turn long, role string, text string")
    plain = {r.conv_id: tuple(r) for r in conversations.Repair(rows).reports.collect()}
    join = conversations.common.spread_join
    monkeypatch.setattr(conversations.common, "spread_join", lambda *a: join(*a, most_bytes=-1))
    assert {r.conv_id: tuple(r) for r in conversations.Repair(rows).reports.collect()} == plain
    assert plain[1][-2:] == (0, "K" * 30_000) and {p[-2:] for c, p in plain.items() if c > 1} == {(repaired([("user", f"{i}.", "") for i in range(3)])[:2])}


# --- 13: archives -----------------------------------------------------------------------------

def arc1(*documents):
    about = b"1 0 Archive\nURL IP-address Archive-date Content-type Archive-length\n"
    out = b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(about) + about
    return out + b"".join(b"\n" + head + b" %d\n" % len(block) + block for head, block in documents)


def test_legacy_headers_of_both_versions():
    http = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\r\n\r\nWARC/1.0\r\n</p>\n\n"
    content = arc1((b"http://a.example/x 10.0.0.1 19970102030405 text/html", http), (b"dns:a.example 10.0.0.2 1997 text/dns", b"19970102 10.0.0.1\n"), (b"http://a.example/a b 10.0.0.3 19970102 no-type", b"\xff\xfe\x00"))
    for packed in (content, gzip.compress(content), b"".join(gzip.compress(content[i : i + 50]) for i in range(0, len(content), 50))):
        got = list(archives.arc_documents(packed))
        assert [(g[1], g[2]["url"], g[2]["date"], g[4]) for g in got] == [(1, "filedesc://old.arc", "19960923142103", False), (1, "http://a.example/x", "19970102030405", False), (1, "dns:a.example", "1997", False), (1, "http://a.example/a b", "19970102", False)]
        assert [g[3] for g in got[1:]] == [http, b"19970102 10.0.0.1\n", b"\xff\xfe\x00"]
        assert all(content[g[0] :].startswith(g[2]["url"].encode()) for g in got)
    about = b"2 0 Archive\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    two = b"filedesc://new.arc 0.0.0.0 19990101000000 text/plain 200 - - 0 new.arc %d\n" % len(about) + about + b"\nhttp://b.example/ 10.0.0.4 19990101000001 text/html 404 abc - 180 new.arc 3\nxyz\n"
    got = list(archives.arc_documents(two))
    assert got[1][1] == 2 and got[1][2]["status"] == "404" and got[1][2]["checksum"] == "abc" and got[1][3] == b"xyz"


def test_broken_archives_are_read_as_far_as_they_go():
    content = arc1((b"http://a.example/ 10.0.0.1 19970102030405 text/html", b"x" * 5000), (b"http://b.example/ 10.0.0.1 19970102030405 text/html", b"y" * 50))
    got = list(archives.arc_documents(content[:-20]))
    assert [(len(g[3]), g[4]) for g in got[1:]] == [(5000, False), (30, True)]
    random_bytes = random.Random(1).randbytes(5000)
    packed = gzip.compress(arc1((b"http://a.example/ 10.0.0.1 19970102030405 text/html", random_bytes)))
    got = list(archives.arc_documents(packed[:3000]))[1:]
    assert [g[4] for g in got] == [True] and 2000 < len(got[0][3]) < 5000 and random_bytes.startswith(got[0][3])
    assert len(list(archives.arc_documents(packed[:3000] + b"\0" * 3000))) <= 2
    assert list(archives.arc_documents(arc1() + b"\nno header here\nrest"))[-1][2] == {"line": "no header here"}
    assert list(archives.arc_documents(b"")) == []


def test_dates_of_any_length():
    assert [archives.iso_date(d) for d in ("19970102030405", "19970102", "1997", "", None, "x")] == ["1997-01-02T03:04:05Z", "1997-01-02T00:00:00Z", "1997-01-01T00:00:00Z"] + ["2000-01-01T00:00:00Z"] * 3


def test_conversion_keeps_bytes_and_makes_types(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n\xff\x00\r\n\r\nbytes"
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.arc.gz").write_bytes(gzip.compress(arc1((b"http://a.example/ 10.0.0.1 19970102030405 text/html", http), (b"dns:a 10.0.0.2 1997 text/dns", b"record"))))
    made = archives.convert(spark, str(tmp_path / "arc"))
    archives.write_warc(made.withColumn("refers_to", F.lit(None).cast("string")), str(tmp_path / "warc"))
    got = {r.type: r for r in archives.read_warc(spark, str(tmp_path / "warc")).where("url IS NOT NULL").collect()}
    assert set(got) == {"response", "resource"}
    assert bytes(got["response"].payload) == b"\xff\x00\r\n\r\nbytes" and got["response"].date == "1997-01-02T03:04:05Z" and got["response"].ip == "10.0.0.1"
    assert got["response"].payload_digest == base64.b32encode(hashlib.sha1(b"\xff\x00\r\n\r\nbytes").digest()).decode() and got["response"].intact
    assert bytes(got["resource"].payload) == b"record" and got["resource"].url == "dns:a" and got["resource"].mime == "text/dns"


PAGES = [(1, "http://x/1", "<p>same</p>"), (5, "http://x/5", "<p>same</p>"), (3, None, "<p>same</p>"), (2, "http://x/ blank", None), (9, "", ""), (4, "é", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\n"), (None, "http://x/n", "no id"), (None, "http://x/m", "<p>same</p>"), (6, "u", "twice"), (6, "u", "twice"), (7, "u", "z" * 300_000), (-8, "u", "é𝄞")]


@pytest.mark.parametrize("salted", [False, True])
def test_pages_through_archives_match_brute_force(spark, tmp_path, monkeypatch, salted):
    if salted:
        join = archives.common.spread_join
        monkeypatch.setattr(archives.common, "spread_join", lambda *a: join(*a, most_bytes=-1))
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, type string").repartition(3)
    archives.archived(pages, str(tmp_path))
    got = sorted(map(repr, (tuple(r) for r in archives.read_pages(spark, str(tmp_path)).collect())))
    wanted, kept = [], set()
    for id_, _, html in sorted(PAGES, key=lambda p: (p[0] is not None, p[0] or 0), reverse=True):
        data = (html or "").encode()
        firsts = [p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None]
        again = data in kept
        kept.add(data)
        wanted.append((id_, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", max(firsts) if again else None))
    assert got == sorted(map(repr, wanted))


def test_small_payloads_are_not_revisited_and_no_pages(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    archives.archived(pages, str(tmp_path / "a"), least_bytes=8)
    got = archives.read_pages(spark, str(tmp_path / "a")).where("record_type = 'revisit'").collect()
    assert sorted(r.payload_bytes for r in got) == [11, 11, 11]
    archives.archived(pages.limit(0), str(tmp_path / "b"))
    assert archives.read_pages(spark, str(tmp_path / "b")).count() == 0


# --- contracts --------------------------------------------------------------------------------

CONTRACTS = {
    "op1_pii": "doc_id bigint,n_email bigint,n_ip bigint,n_card bigint,n_phone bigint,base_sha256 string,spans string",
    "op2_rules": "doc_id bigint,n_words bigint,word_chars bigint,n_symbols bigint,n_dup_lines bigint,n_repeat_words bigint,base_failed boolean,kept boolean",
    "op3_main_text": "page_id bigint,url string,text string,n_chars bigint",
    "op4_near": "doc_id bigint,n_shingles bigint,component_id bigint",
    "op5_language": "doc_id bigint,held_out boolean,lang_pred string,score double",
    "op6_mixing": "doc_id bigint,size bigint,source_size bigint,target double,taken bigint",
    "op7_toxicity": "doc_id bigint,held_out boolean,score double,predicted int",
    "op8_neighbours": "query_id bigint,rank int,vec_id bigint,score double",
    "op9_quality": "doc_id bigint,held_out boolean,score double,predicted int",
    "op11_fim": "doc_id bigint,n bigint,form string,prefix_chars bigint,middle_chars bigint,output_sha256 string,restored_sha256 string",
    "op12_repair": "conv_id bigint,gaps bigint,blank bigint,duplicate bigint,truncated bigint,illegal bigint,cost bigint,audit string,repaired_sha256 string",
    "op13_archives": "page_id bigint,payload_bytes bigint,payload_digest string,record_type string,refers_to bigint",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract_columns(spark, name):
    made = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert [f"{c} {t}" for c, t in made.dtypes][: CONTRACTS[name].count(",") + 1] == CONTRACTS[name].split(",")
