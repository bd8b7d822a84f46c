from __future__ import annotations

import re

import pytest
from brute import dice
from conftest import documents

from tenderlake.llm import chat, licenses, queries, urls


def test_licences(spark, odd_documents, no_documents):
    whole = licenses.TEMPLATES["MIT"]
    wrapped = re.sub(r"(.{60}\S*) ", "\\1\n", whole)
    texts = [
        f"Some text.\nReleased under the MIT License.\nMore.", f"intro\n\n{wrapped}\n\nend", wrapped, whole.replace("free", "no"),
        "released, under: the mit... LICENSE", "Released under the MIT", None, "", "license", whole + " " + whole[:200],
    ]
    found = {r.doc_id: r for r in licenses.scan(documents(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    best = lambda text: max(((dice(text, t), n) for n, t in licenses.TEMPLATES.items()), key=lambda x: x[0])
    assert [found[k].license for k in range(10)] == ["MIT-line", "MIT", "MIT", "MIT", "MIT-line", "MIT-line", None, None, None, "MIT"]
    for k in (2, 3, 4, 5, 9):
        assert found[k].dice == pytest.approx(best(texts[k])[0])
    assert [m.license for m in found[0].matches] == ["MIT-line"] and found[0].matches[0].passage == 1
    assert licenses.scan(odd_documents).where("license is null").count() == odd_documents.count()
    assert licenses.scan(odd_documents, {}).where("n_passages = 0").count() == odd_documents.count()
    assert licenses.scan(no_documents).count() == 0


def apart(text, *ends):
    """The text with blank lines after the given words."""
    for end in ends:
        assert end in text
        text = text.replace(end + " ", end + "\n\n")
    return text


def test_licences_inside_longer_documents(spark):
    """Paragraphs apart by blank lines and notices inside a line, by a plain search over all runs of words."""
    of = licenses.TEMPLATES
    prose = " ".join(f"of the w{k} and in the x{k}" for k in range(60))
    mit = apart(of["MIT"], "conditions:", "portions of the Software.")
    apache = apart(of["Apache-2.0"], "with the License.", "LICENSE-2.0")
    gpl = apart(of["GPL-3.0"], "any later version.", "PARTICULAR PURPOSE.")
    bsd = apart(of["BSD-2-Clause"], "are met:", "disclaimer.")
    terms = "This work is licensed under the terms of the GNU General Public License, version 3."
    texts = [f"{prose}\n\n{t}\n\n{prose}" for t in (mit, apache, gpl, bsd, mit.replace("any person", "every man"))] + [
        f"{prose}. This file is released under the MIT License. {prose}",
        f"a b c d e f. Licensed under CC BY-NC 4.0. {prose}", f"{prose} {terms} {prose}", f"{prose}. Released under the MIT. {prose}",
        f"{prose} {of['MIT'][:400]} {prose}", prose, f"{prose}\n\n{mit}\n\n{of['GPL-3.0-line']}", "the software " * 500,
    ]
    found = {r.doc_id: r for r in licenses.scan(documents(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    expected = ["MIT", "Apache-2.0", "GPL-3.0", "BSD-2-Clause", "MIT", "MIT-line", "CC-BY-NC-4.0-line", "GPL-3.0-line", "MIT-line", None, None]
    assert [found[k].license for k in range(11)] == expected
    assert all(found[k].n_passages == 0 for k in range(11))
    assert {w.license for w in found[11].windows} == {"MIT", "GPL-3.0-line"} and found[12].license is None
    for k in (0, 4, 5, 6, 7, 8):
        w = re.findall("[a-z0-9]+", texts[k].lower())
        template = of[expected[k]]
        size = len(re.findall("[a-z0-9]+", template.lower()))
        begins = range(len(w)) if size < 20 else range(400, 440)
        runs = (" ".join(w[i:j]) for i in begins for j in range(i + size // 2, min(len(w), i + size * 3 // 2) + 1))
        assert found[k].dice == pytest.approx(max(dice(run, template) for run in runs))


MESSAGES = [
    (1, 0, "user", "Hello there my friend"),
    (1, 1, "assistant", "General greetings to you all\n\nSecond paragraph, longer"),
    (1, 2, "user", "On Monday Bob wrote:\n> General greetings  to YOU all\nthanks for that"),
    (1, 3, "assistant", "Sure.\n\nFine then with me"),
    (1, 4, "user", "> Hello there my friend\nback to start"),
    (1, 5, "assistant", ">> General greetings to you all\n> thanks for that\nok"),
    (1, 6, "user", "> > > > never said anywhere\nwell"),
    (1, 7, "user", "> Fine then with me\n"),
    (2, 4, "user", "> Hello there my friend\nother conversation"),
    (2, 4, "user", "> Hello there my friend\nother conversation"),
    (2, 9, None, None),
    (None, None, None, "> x y z"),
    (None, 1, "user", ""),
]


def test_quotes_are_linked(spark):
    schema = "conv_id long, turn long, role string, text string, run long, chain string, position long"
    rows = spark.createDataFrame([(*m, 1, "x", 1) for m in MESSAGES], schema)
    found = sorted(
        (r for r in chat.conversations(rows).collect() if r.conv_id is not None), key=lambda r: (r.conv_id, r.position)
    )
    one = [r for r in found if r.conv_id == 1]
    # 2 quotes 1, 4 quotes 0, 5 quotes 2 (the outer quote decides), 6 finds nothing, 7 quotes 3.
    assert [(r.turn, r.parent_turn) for r in one] == [(0, None), (1, 0), (2, 1), (3, 2), (7, 3), (5, 2), (6, 5), (4, 0)]
    text = {r.turn: r.text for r in one}
    assert text[2] == "thanks for that" and text[5] == "ok" and text[7] == "" and "Second" in text[1]
    assert {r.turn: (r.n_quotes, r.n_linked) for r in one}[5] == (2, 2)
    two = [r for r in found if r.conv_id == 2]
    assert [(r.position, r.turn, r.parent_turn) for r in two] == [(0, 4, None), (1, 4, None), (2, 9, 8)]
    assert chat.conversations(rows).where("conv_id is null").count() == 2
    assert chat.conversations(rows.where("false")).count() == 0


def test_long_chains_of_quotes(spark):
    """Each message quotes the one two turns before; order by a plain depth-first walk."""
    said = lambda k: f"message number {k} speaks"
    rows = [(1, k, "u", f"> {said(k - 2)}\n{said(k)}" if k > 1 else said(k)) for k in range(40)]
    found = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    below = {k: [] for k in range(-1, 40)}
    for k in range(1, 40):
        below[k - 2 if k > 1 else 0].append(k)
    walk, stack = [], [0]
    while stack:
        k = stack.pop()
        walk.append(k)
        stack += sorted(below[k], reverse=True)
    assert [r.turn for r in sorted(found, key=lambda r: r.position)] == walk


def test_given_conversations_keep_their_order(spark, tables):
    found = queries.QUERIES["op3_chat_formatting"](spark, "/root/testdata/sf0.001").collect()
    given = {(r.conv_id, r.turn): r.text for r in tables("conversations").collect()}
    assert {(r.conv_id, r.turn): r.text for r in found} == given
    assert all(r.position == r.turn for r in found if r.n_linked == 0)


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :])[0]


def rule_of(host, path):
    fits = []
    for rule in queries.URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append(rule)
    return max(fits, key=len, default=None)


ODD_URLS = [
    None, "", "net/", "http://NET/", "HTTP://A.example.NET/en/x?y", "a://b.net", "a://example.net/de/#/en/", "x://É.org/fr/",
    "http://example.com/de", "http://example.com/de/", "http://notexample.com/de/", "s://u@h.example.com:80/de/", "a://org/fr/\nq",
    "a\nb://c.org/fr/?a=1&b=2", "http://1.2.3.4/77?x=1&y=2&&z", "http://a.org/fr/" + "p" * 50_000, "http://a.com/", "http://a.com/",
]


def test_url_rules_and_verdicts(spark, tables):
    pages = tables("pages").select("page_id", "url").collect()
    rows = [(r.page_id, r.url, "x") for r in pages] + [(10_000 + k, u, "x") for k, u in enumerate(ODD_URLS)]
    table = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = {r.page_id: r for r in urls.verdicts(table, queries.URL_RULES).collect()}
    assert len(found) == len(rows)
    for page, url, _ in rows:
        r = found[page]
        assert (r.host, r.path) == split_url(url), url
        assert r.rule == rule_of(r.host, r.path), url
        assert r.verdict == queries.URL_RULES[r.rule] if r.rule else r.verdict == ("block" if r.score >= 0.5 else "allow")
    assert urls.verdicts(table.where("false"), queries.URL_RULES).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    bad = [f"http://x{k}-win-{k}.example.com/a{k}?p={k}&q={k}&r=1" for k in range(120)]
    good = [f"http://site.example.org/page/{'abcdefgh'[k % 8]}/text" for k in range(120)]
    labelled = spark.createDataFrame(
        [(u, True) for u in bad[:80]] + [(f"{u}{k}", False) for k, u in enumerate(good[:80])] + [(None, True), ("x", None)],
        "url string, blocked boolean",
    )
    pages = spark.createDataFrame(list(enumerate(bad[80:] + good[80:])), "page_id long, url string")
    found = {r.page_id: r.verdict for r in urls.verdicts(pages, {}, labelled).collect()}
    assert [found[k] for k in range(80)] == ["block"] * 40 + ["allow"] * 40
    only = urls.verdicts(pages, {}, labelled.where("blocked")).collect()
    assert {r.verdict for r in only} == {"block"}
    assert {r.verdict for r in urls.verdicts(pages, {}, labelled.where("false")).collect()} == {"allow"}


def test_unseen_suffixes_are_judged_by_looks(spark):
    """Every labelled URL has a suffix of its own; looks tell nine of ten."""
    bad = lambda k: f"http://x{k}-win-{k}-now.shop.s{k}/a{k}/b{k}?p={k}&q={k}&r={k}"
    good = lambda k: f"http://library.example.s{k}/page/reading"
    look = [(k, k % 2 == 0) for k in range(800)]
    known = [((bad if (looks == (k % 10 != 0)) else good)(k), looks) for k, looks in look]
    labelled = spark.createDataFrame(known, "url string, blocked boolean")
    new = [(k, (bad if k < 40 else good)(5000 + k)) for k in range(80)]
    found = {r.page_id: r for r in urls.verdicts(spark.createDataFrame(new, "page_id long, url string"), {}, labelled).collect()}
    assert [found[k].verdict for k in range(80)] == ["block"] * 40 + ["allow"] * 40


def test_suffix_counts_leave_out_a_fold(spark):
    known = [(f"http://h{k % 7}.s{k % 3}/p{k}", float(k % 5 < 2 or k % 7 == 1)) for k in range(200)] + [("http://one.alone/", 1.0)]
    df = spark.createDataFrame(known, "url string, label double").withColumn("host", urls.host("url")).withColumn("f", urls.fold("url"))
    rows = df.collect()
    want = {}
    for left_out in range(-1, urls.FOLDS):
        hosts = {}
        for r in rows:
            if r.f != left_out:
                hosts.setdefault(r.host, []).append(r.label)
        for host, labels in hosts.items():
            shares, n, many = want.get((host.rsplit(".")[-1], left_out), (0, 0, 0))
            share = round(sum(labels) / len(labels) * urls._UNIT)
            want[host.rsplit(".")[-1], left_out] = shares + share, n + 1, many + len(labels)
    got = {(r.suffix, r.fold): (r.shares, r.hosts, r.urls) for r in urls.suffix_counts(df).collect()}
    assert got == want and ("alone", -1) in got
    assert len([k for k in got if k[0] == "alone"]) == urls.FOLDS  # its own fold knows nothing of it


def test_suffixes_outside_the_sample_count(spark):
    """Only the suffix tells blocked URLs, and most suffixes are not in the sample that the trees learn from."""
    known = [(f"http://h.s{k:03d}/p{j:02d}", k % 2 == 0) for k in range(100) for j in range(20)]
    labelled = spark.createDataFrame(known, "url string, blocked boolean")
    pages = spark.createDataFrame([(k, f"http://h.s{k:03d}/p77") for k in range(100)], "page_id long, url string")
    found = {r.page_id: r.verdict for r in urls.verdicts(pages, {}, labelled, rows=60).collect()}
    assert found == {k: "allow" if k % 2 else "block" for k in range(100)}
