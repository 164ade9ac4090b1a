"""Quality rules, personal data, toxicity, pages, BPE and packing."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from helpers import SCHEMA, awkward, frame, prose, words
from pyspark.sql import functions as F

from spillway.llm import bpe, html, packing, pii, quality, toxicity


def repeats(w):
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)})


def test_quality_statistics_of_awkward_documents(spark):
    rows = [*awkward(), (20, "a b c d e f g h " * 9, "en", "s", 0), (21, "# % x|y\n\n # % x|y\n# % x|y", "en", None, 0)]
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.apply_rules(frame(spark, rows)).collect())
    want = Counter()
    for i, t, *_ in rows:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        n = repeats(w)
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w))] += 1
    assert got == want


def test_lines_of_a_host_are_removed_and_depleted_documents_rejected(spark):
    footer = "Read 12 more stories here"
    rows = [(k, f"{prose(k, 30)}\n{footer.upper() if k % 2 else footer}\n{prose(k + 500, 30)}", "en", "a", 0) for k in range(30)]
    rows += [(100 + k, f"{prose(7, 40)}\n{prose(8, 40)}", "en", "a", 0) for k in range(60)]  # copies of one text are no template
    rows += [(200 + k, f"{footer}\n{prose(900 + k, 25)}", "en", "b", 0) for k in range(3)]
    offers = [f"offer {c} of the shop for you today" for c in "abcdef"]
    rows += [(400 + k, "\n".join(f"{prose(3000 + 40 * k + j, 4)}\n{x}" for j, x in enumerate(offers)), "en", "d", 0) for k in range(25)]
    out = {r["doc_id"]: r for r in quality.apply_rules(frame(spark, rows)).collect()}
    assert all(out[k]["kept"] and "stories" not in out[k]["clean_text"].lower() and out[k]["n_removed_words"] == 5 for k in range(30))
    assert all(out[100 + k]["kept"] and out[100 + k]["n_removed_words"] == 0 for k in range(60))
    assert all(out[200 + k]["clean_text"] == rows[90 + k][1] for k in range(3))
    assert all(not out[400 + k]["kept"] and not out[400 + k]["base_failed"] for k in range(25))
    assert quality.apply_rules(frame(spark, [])).collect() == []


def test_a_line_counts_once_for_each_distinct_document_that_has_it(spark):
    footer = ["all rights of this site reserved", "read more stories of this site", "follow this site for more news"]
    rows = [(k, f"{prose(k, 30)}\n\n{footer[0]}\n\n{prose(k + 500, 30)}", "en", "a", 0) for k in range(30)]  # between blank lines
    rows += [(100 + k, "\n".join([prose(1000 + k, 30), *footer]), "en", "b", 0) for k in range(30)]  # between its like
    rows += [(200 + k, "\n".join([prose(2000, 5), *footer]), "en", "c", 0) for k in range(60)]  # copies are one document
    rows += [(300 + k, "\n\n".join([prose(3000 + k, 8), *footer]), "en", "d", 0) for k in range(25)]
    out = {r["doc_id"]: r for r in quality.apply_rules(frame(spark, rows)).collect()}
    assert all(out[k]["kept"] and out[k]["n_removed_words"] == 6 and footer[0] not in out[k]["clean_text"] for k in range(30))
    assert all(out[100 + k]["kept"] and out[100 + k]["n_removed_words"] == 18 and out[100 + k]["clean_text"] == prose(1000 + k, 30) for k in range(30))
    assert all(out[200 + k]["kept"] and out[200 + k]["n_removed_words"] == 0 for k in range(60))
    assert all(not out[300 + k]["kept"] and not out[300 + k]["base_failed"] for k in range(25))


def test_a_document_adds_at_most_one_to_the_count_of_a_line(spark):
    line = "the same sentence of a refrain again"
    rows = [(k, "\n".join(f"{prose(5000 + 40 * k + j, 6)}\n{line}" for j in range(30)), "en", "a", 0) for k in range(5)]
    rows += [(100 + k, prose(k, 30), "en", "a", 0) for k in range(40)]
    out = quality.apply_rules(frame(spark, rows)).collect()
    assert all(r["n_removed_words"] == 0 and r["clean_text"] == r["text"] for r in out)


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in v.split("."))) or (kind == "phone" and 9 <= len(d) <= 15)


PRIVATE = [
    "write a@b.com_x@y.com or 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 41111111111111111111", "+1 (609) 555-7932 é😀 +49 30 1234567 +1+12345678901 +5 5",
    "1.1.1.300 0010.1.1.255 .1.2.3.4. 1..2.3.4", "a@b@c.de x@y @z.com a@b.c. %@-.-", "a" * 30000 + " " + "1" * 30000 + " " + "1." * 5000, "1-2 3" * 4000, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ssn 123-45-6789',
]


def test_private_data_of_awkward_documents(spark):
    rows = [*awkward(), *[(50 + k, t, "en", "s", 0) for k, t in enumerate(PRIVATE)]]
    out = pii.report(frame(spark, rows)).collect()
    want = Counter()
    for i, t, *_ in rows:
        base = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(t or "") if passes(k, m[0])]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want[(i, *[sum(k == x[0] for x in base) for k in PATTERNS], hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:-1] for r in out) == want
    assert all(r["base_sha256"] == hashlib.sha256(",".join(s for s in r["spans"].split(",") if s.split(":")[0] in PATTERNS).encode()).hexdigest() for r in out)
    assert pii.report(frame(spark, [])).collect() == []


FURTHER = {
    "local_phone": re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9])(?:[A-Fa-f0-9]{32,}|(?:sk|pk|ghp|gho|xoxb|AKIA)[_-]?[A-Za-z0-9]{16,})(?![A-Za-z0-9])"),
}


def test_added_spans_are_candidates_apart_from_base_ones(spark):
    """Candidates and overlaps recounted; a model that takes all for personal adds all of them that are apart."""
    r = random.Random(12)
    parts = ["token f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda", "a" * 40 + "1" * 300, "sk_" + "Ab1" * 60, "ssn 123-45-6789", "078-05-1120", "call 555-123-4567", "(212) 555 0199", "+1 (605) 555-9305 4078918989542222", "1.2.3.400", "x@y.org", "10.0.0.1", "4111 1111 1111 1111", "4111 1111 1111 1112", "12 345", ", ", "word", "+49 30 1234567"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randrange(1, 25))) for _ in range(120)] + [" ".join(parts * 60)]
    out = {x["doc_id"]: x["spans"] for x in pii.report(frame(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])).collect()}
    kinds = Counter()
    for k, t in enumerate(texts):
        base = [(n, m.start(), m.end()) for n, p in PATTERNS.items() for m in p.finditer(t) if passes(n, m[0])]
        possible = {(n, m.start(), m.end()) for n, p in FURTHER.items() for m in p.finditer(t)}
        possible |= {("number", m.start(), m.end()) for n in ("ip", "phone", "card") for m in PATTERNS[n].finditer(t) if not passes(n, m[0]) and (n != "card" or 13 <= len(re.sub("[^0-9]", "", m[0])) <= 19)}
        apart = {x for x in possible if not any(x[1] < b[2] and b[1] < x[2] for b in base)}
        got = [(x.split(":")[0], *map(int, x.split(":")[1:])) for x in out[k].split(",") if x]
        added = [x for x in got if x[0] not in PATTERNS]
        assert len(got) == len(set(got)) and [x for x in got if x[0] in PATTERNS] == base and set(added) <= apart
        kinds.update(x[0] for x in added)
        # What looks alike is judged alike: a kind with its context is either taken everywhere or nowhere, secrets after a cue always.
        assert {x for x in apart if x[0] == "secret" and t[: x[1]].endswith("token ")} <= set(added)
    assert kinds["secret"] > 20


def test_time_grows_with_the_length_of_a_text(spark):
    texts = [(1, "ab 12, " * 16000, "en", "s", 0), (2, "ab 4111 1111 1111 1112, 1.2.3.4, " * 3500, "en", "s", 0)]
    pii.report(frame(spark, [(1, "a@b.org 4111 1111 1111 1111", "en", "s", 0)])).collect()
    began = time.perf_counter()
    out = pii.report(frame(spark, texts)).collect()
    assert {r["doc_id"]: r["n_ip"] for r in out} == {1: 0, 2: 3500} and time.perf_counter() - began < 30


def test_spans_are_masked(spark):
    out = pii.mask(frame(spark, [(1, "é a@b.com, 1.2.3.4!", "en", "s", 0), (2, None, "en", "s", 0), (3, "clean", "en", "s", 0)])).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == ["é <EMAIL>, <IP>!", None, "clean"] and out[0]["key"] == "own"


def test_labelers_that_agree_are_trusted(spark):
    votes = [([1, 1, 1, 1, 1], 80), ([-1, -1, 0, -1, -1], 120), ([1, -1, 1, 1, 1], 10), ([-1, 1, 0, -1, -1], 30)]
    p = {tuple(r["votes"]): r["p"] for r in pii.fit_labelers(spark.createDataFrame(votes, "votes array<int>, n bigint")).collect()}
    assert p[(1, 1, 1, 1, 1)] > 0.95 and p[(-1, -1, 0, -1, -1)] < 0.05 and p[(1, -1, 1, 1, 1)] > 0.9 and p[(-1, 1, 0, -1, -1)] < 0.1


def test_toxic_words_are_found_in_texts_that_were_held_out(spark):
    bad = ["grumblefoot", "snarkwaddle", "blitherskite"]
    rows = [(k, " ".join([*prose(k, 40).split(), *([bad[k % 3], bad[(k + 1) % 3]] if k % 4 == 1 else []), *prose(k + 9999, 20).split()]), "en", "s", 0) for k in range(600)]
    docs = frame(spark, [*rows, *[(10000 + (r[0] or 0), *r[1:]) for r in awkward()]])
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 1)) for k in range(600)] + [(5, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert [out[k]["held_out"] for k in range(600)] == [k in set(held) for k in range(600)]
    hits = [out[k]["predicted"] == int(k % 4 == 1) for k in held]
    assert sum(hits) / len(hits) > 0.95 and all(0 <= r["score"] <= 1 for r in out.values()) and out[10004]["predicted"] == 0
    none = toxicity.score(docs, toxicity.learn(docs, labels.limit(0)))
    assert none.agg(F.max("score")).first()[0] == 0 and toxicity.score(frame(spark, []), None).collect() == []


def test_scores_are_the_bytes_that_the_dictionaries_save():
    """A window's distance, a text's features and the curve, recomputed; and a dictionary that was trained on a text saves it."""
    import zstandard

    plain, marked = [b"the quick brown fox " * 20, b"the lazy dog sleeps " * 20, b"a quick dog "], [b" grumblefoot ", b" grumblefoot snark ", b" snark "]
    pairs = list(zip(plain, marked, strict=True))
    distance = toxicity.Distance(pairs)

    def length(content, w):
        d = zstandard.ZstdCompressionDict(content + bytes(range(1, 25)), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=10)
        return len(zstandard.ZstdCompressor(dict_data=d, level=10, write_content_size=False, write_checksum=False, write_dict_id=False).compress(w + bytes(range(1, 25))))

    for w in (b" grumblefoot ", b" snark ", b" quick ", b" other ", b" x "):
        hit = length(plain[0], w) > length(b"".join(marked) + plain[0], w)
        assert distance.saved(w) == (max(0, sorted(length(p, w) - length(m + p, w) for p, m in pairs)[1]) if hit else 0)
    assert distance.saved(b" grumblefoot ") >= 6 and distance.saved(b" quick ") == 0
    x = np.array([0, 0, *[distance.saved(f" {w} ".encode()) for w in ("grumblefoot", "quick", "snark", "grumblefoot")]])
    top = sorted(x)[::-1]
    assert distance.features("Grumblefoot quick\n snark  GRUMBLEFOOT") == [1.0, min(top[0], 9), min(top[1], 9), *[float(np.log1p((x >= n).sum())) for n in range(1, 7)], 10.0 * (x >= 3).mean(), 10.0 * (x >= 1).mean(), float(np.log(6))]
    assert toxicity.windows("A\tb " + "x" * 100) == [b" a ", b" b ", b" " + b"x" * 47, b"x" * 48, b"x" * 5 + b" "]
    texts = [[f" w{k}a ".encode(), b" grumblefoot ", f" v{k}b ".encode()] for k in range(200)]
    assert b"grumble" in toxicity.toxic_dictionary(texts, b"nothing of it " * 20)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<header>Site</header><div class="cookie-notice">Accept</div><!-- x --><div class='ad'>Buy</div><article><h1>Head &amp; <i>line</i></h1><p>One&nbsp;two<br>three
 four<p>Five &lt;b&gt; &#233;&#x1F600; <span class="share">Share</span> six<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><form>Name <input></form><aside>More</aside>
<div class="comments"><p>First!</p></div></article><section id="comments">Bad</section><footer>&copy; 2020</footer></body></html>"""


def test_the_article_and_nothing_else():
    assert html.Page(PAGE).text()[0].split("\n\n") == ["Head & line", "One two three four", "Five <b> é😀 six", "a", "b", "c", "d"]
    text = lambda x: html.Page(x).text()[0]
    assert text("") == "" and text("plain < text &amp") == "plain < text &" and text("<p>open <b>bold<script>x") == "open bold"
    assert text("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert text("<p>a <span class=ad>b <span>c</span> d</span> e<p>f <span class=ad>open<p>g") == "a e\n\nf\n\ng"
    assert text("<p>a<span class=ad><div>b</div></span> c</p>d <img class=ad> e <span class=ad /> f") == "a\n\nc\n\nd e f"


def test_many_open_elements_take_little_time():
    for x in ("<span class=ad>", "<span class=ad>x", "<div><span class=ad>", "</p>", "</span>", "<p>", "<li>", "<div class=ad>"):
        began = time.perf_counter()
        html.Page(f"<article><p>text</p>{x * 10000}")
        assert time.perf_counter() - began < 1


@pytest.mark.parametrize("most", [200_000, 0])
def test_templates_of_a_host(spark, most, monkeypatch):
    monkeypatch.setattr(html, "BROADCAST_ROWS", most)
    box = "<div><p>About this site</p><p>Terms and more</p></div>"
    page = lambda k: f"<body>{box}<div><p>{prose(k, 9)}</p><p>{prose(k + 70, 9)}</p></div></body>"
    rows = [(k, f"http://A.example/{k}", page(k)) for k in range(12)] + [(50 + k, "http://b.example/x", page(900 + k)) for k in range(2)]
    rows += [(100 + k, "http://c.example/y", f"<body><p>{prose(5, 9)}</p></body>") for k in range(30)] + [(200, None, None), (201, "nonsense", ""), (202, "http://a.example", box)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("own")).withColumn("hits", F.lit("own"))
    out = {r["page_id"]: r for r in html.extract(df).collect()}
    assert all(out[k]["text"] == f"{prose(k, 9)}\n\n{prose(k + 70, 9)}" and out[k]["n_chars"] == len(out[k]["text"]) and out[k]["n_template_blocks"] == 2 for k in range(12))
    assert out[50]["text"].startswith("About this site") and out[129]["text"] == prose(5, 9) and out[200]["text"] == out[201]["text"] == out[202]["text"] == ""
    assert html.extract(df.limit(0)).collect() == []


def subtree_strings(source):
    """(subtree as a string, where it stands) of each element of well-formed pages, by the library's own parser."""
    import xml.etree.ElementTree as ET

    found = []

    def walk(e, within):
        inside = within or e.tag == "article"
        if e.tag not in ("html", "body", "article"):
            found.append((ET.tostring(e, encoding="unicode", method="xml").partition(e.tail or "\0")[0], "article" if within else "prose" if e.tag == "p" else "other"))
        for x in e:
            walk(x, inside)

    walk(ET.fromstring(source), False)
    return set(found)


def test_what_a_plain_count_finds_recurring_is_removed(spark):
    """Menus of a few forms, a line in many articles, one in nearly all; nothing here goes by its kind or name."""
    r = random.Random(9)
    menus = [f"<section><p>{prose(40 + k, 3)}</p><p>{prose(50 + k, 2)}</p></section>" for k in range(4)]
    rows = []
    for k in range(60):
        lines = [prose(1000 + 10 * k + j, 8) for j in range(3)] + (["some articles say this"] if k % 3 == 0 else []) + (["nearly all say this"] if k % 10 else [])
        rows.append((k, f"http://h{k % 2}.example/{k}", f"<html><body>{r.choice(menus)}<section><p>{prose(5000 + k, 3)}</p></section><article>{''.join(f'<p>{x}</p>' for x in lines)}</article></body></html>"))
    pages = defaultdict(list)
    for _, url, source in rows:
        pages[url[:10]].append(subtree_strings(source))
    template = {}
    for host, all_pages in pages.items():
        counts = Counter(x for p in all_pages for x in p)
        share = {"other": 0.05, "prose": 0.2, "article": 0.5}
        template[host] = {x for x, n in counts.items() if n > 4 and n > share[x[1]] * len(all_pages)}
    out = {x["page_id"]: x for x in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k, url, source in rows:
        mine = subtree_strings(source) & template[url[:10]]
        articles = re.search("<article>(.*)</article>", source)[1]
        want = [x for x in re.findall("<p>(.*?)</p>", articles) if (f"<p>{x}</p>", "article") not in mine]
        gone = sum(len(re.findall("<p>", x)) for x, where in mine if where != "prose")
        assert out[k]["text"].split("\n\n") == want and out[k]["n_template_blocks"] == gone
    assert any("nearly" in x[0] for x in template["http://h0."]) and not any("some" in x[0] for x in template["http://h0."])
    assert sum(x["n_template_blocks"] > 0 for x in out.values()) > 50


def test_bpe_is_that_of_the_library(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [*awkward(), (60, "it's 'S don't  two  x \n\n y\t\t z  　é😀é ١٢٣ Ωmega <|endoftext|>\x1c\x85 end   ", "en", "s", 0), (61, "   \n ", "en", "s", 0)]
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for block in (200, 1 << 20):
        out = bpe.decode(bpe.encode(frame(spark, rows), path, public_tokenizers.PATTERN, block=block), path).collect()
        got = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out)
        assert got == Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows)
    assert bpe.encode(frame(spark, []), path, public_tokenizers.PATTERN).collect() == []


def check_packing(out, want):
    """Every id once, in order; sequences full but for powers of two."""
    ids, places = defaultdict(list), defaultdict(list)
    for r in sorted(out, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"])):
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        ids[r["doc_id"]] += r["ids"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in ids.items()} == {k: sorted(i for x in v for i in x) for k, v in want.items()}
    for p in places.values():
        p.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and p[0][0] == 0
        total = p[-1][0] + p[-1][1]
        assert total == 2048 or total < 2048 and total & (total - 1) == 0


@pytest.mark.parametrize("buffer", [3000, 1 << 21])
def test_packing_of_awkward_documents(spark, buffer):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*awkward(), (60, "Don't İstanbul ΣΑΣ é ﬁ 12,5 <|endoftext|>x a.b's !?… 漢字 Ⅷ", "en", "s", 0)]
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    out = packing.pack(frame(spark, rows), path, with_ids=True, buffer_tokens=buffer).collect()
    check_packing(out, want)
    by_doc = defaultdict(list)
    for r in sorted(out, key=lambda r: r["start"]):
        by_doc[r["doc_id"]] += r["ids"]
    assert all(by_doc[i] == want[i][0] for i in want if len(want[i]) == 1)
    assert packing.pack(frame(spark, []), path).collect() == []


def test_costs_are_balanced():
    lengths = np.array([1500] * 20 + [200] * 50 + [40] * 27)
    pieces = packing.assign(lengths, 2048)[0]
    cost = Counter()
    for _, _, n, s, _ in pieces:
        cost[s] += n * n
    full = [c for s, c in cost.items() if sum(p[2] for p in pieces if p[3] == s) == 2048]
    assert len(full) == int(lengths.sum() // 2048) and max(full) <= 2.5 * sorted(full)[len(full) // 2]
    assert packing.assign(np.array([5]), 2048) == ([], [(0, 0, 5)], 0)
    assert packing.tail([(0, 0, 5)], 0) == ([(0, 0, 4, 0, 0), (0, 4, 1, 1, 0)], 2)


def test_names_of_the_tokenizers_own_tokens_are_text_unless_spelt_alike():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        encoder = packing.WordEncoder(f.read(), 1)
    tokenizer = Tokenizer.from_file(path)
    r = random.Random(4)
    texts = ["<|ENDOFTEXT|> x", "a <|StartOfText|>b", "<|endoftext|><|ENDOFTEXT|> DON'T", "<|endof text|>"]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|", "|>", "Word", "word's", "WORD.", " ", " ", "\n", "É", "12"]
    texts += ["".join(r.choice(parts) for _ in range(r.randrange(1, 12))) for _ in range(300)]
    ids, lengths = encoder.encode(pa.array(texts))
    ends = np.cumsum(lengths)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_a_task_has_one_tail(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = frame(spark, [(k, prose(k, 50 + 37 * (k % 60)), "en", "s", 0) for k in range(150)]).coalesce(1)
    out = packing.pack(docs, path, buffer_tokens=20000).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    short = [r["n"] for r in out if r["n"] < 2048]
    assert len(out) > 30 and len(short) <= 11 and len(set(short)) == len(short)


def test_pipeline_agrees_with_its_steps_in_plain_python(spark, tmp_path):
    """Small documents through all stages, against plain versions of each."""
    import corpus_pipeline
    from helpers import components, cut
    from tokenizers import Tokenizer

    passage = prose(31, 55)
    rows = [(k, f"{prose(k, 60)} mail me@site{k}.org", "en", f"s{k % 3}", 0) for k in range(10)]
    rows += [(20, rows[3][1], "en", "s1", 0), (21, rows[4][1] + " extra", "en", "s1", 0), (22, "short", "en", "s1", 0), (23, None, "en", "s1", 0), (24, "a b c d e f g h " * 9, "en", "s1", 0)]
    rows += [(30 + k, f"{prose(300 + k, 90)} {passage} {prose(400 + k, 90)}", "en", "s2", 0) for k in range(3)]
    where = tmp_path / "in"
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(where / "documents.parquet"))
    kept = [(i, t) for i, t, *_ in rows if len(words(t)) >= 20 and 100 * repeats(words(t)) <= 30 * len(words(t))]
    groups = {d: c for d, _, c in components(kept)}
    kept = [(i, t) for i, t in kept if groups[i] == i]
    kept = [(i, " ".join(w)) for i, _, w in cut(kept) if w]
    kept = [(i, PATTERNS["email"].sub("<EMAIL>", t)) for i, t in kept]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [[*tokenizer.encode(t, add_special_tokens=False).ids, 1]] for i, t in kept}
    check_packing(corpus_pipeline.run(spark, str(where)).collect(), want)
