from __future__ import annotations

import itertools
import time
import unicodedata
from collections import defaultdict

import numpy as np
import pytest

from gleanframe.llm import body, lexicon, prose, quality, repeats, residue

COMMON = [("en", w) for w in "the of and to a in is that for it was on with as by this from".split()] + [("de", w) for w in "der die das und in zu den von mit ist auf für ein eine im am".split()]
PROSE = "The old mill is at the edge of the town, and the road to the valley was closed by the snow in the winter."
GERMAN = "Die alte Mühle ist am Rand der Stadt, und der Weg in das Tal ist im Winter von dem Schnee auf lange zu."


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(COMMON, "lang string, word string")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string, row string, line_no string, n string")


def doc(i, text, lang=None, source="s", url=None):
    return (i, text, lang, source, url, "x", "y", "z")


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("Home | News | Sport", prose.MENU), ("- About us", prose.MENU), ("* [Termine](/termine)", prose.MENU), ("Startseite · Kontakt · Wetter", prose.MENU), ("Inicio » Empleo > Algo", prose.CRUMB),
        ("You may also like", prose.RELATED), ("LES PLUS LUS:", prose.RELATED), ("© 2024 X. All rights reserved.", prose.SURROUNDING), ("Read 12 comments on The Post", prose.SURROUNDING), ("Steun  De  Bode  vanaf 3 per maand", prose.SURROUNDING),
        ("By Ann Lee, The Post", prose.BYLINE), ("A B | The Post | updated 2024-01-02", prose.BYLINE), (PROSE, 0), ("", 0), ("Why the mill matters", 0), ("By the way the mill was closed.", 0), ("x" * 5000, 0),
    ],
)
def test_surroundings(line, kind):
    assert prose.surrounding(line) == kind


def test_statistics_and_odd_input(spark, words):
    table = "name | n | m\nAb Cd | 1 | 2\nEf Gh | 3 | 4"
    rows = [doc(1, PROSE), doc(2, table), doc(3, None), doc(4, ""), doc(5, " \n\r\n "), doc(None, GERMAN, "de"), doc(7, PROSE + "\n" + table * 30), doc(8, "a " * 100_000), doc(1, PROSE)]
    got = quality.text_statistics(docs(spark, rows), words).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].sentence_share == 1 and by[1].common_share > 0.4 and by[1].end_punct_share == 1 and by[1].n_words == len(PROSE.split())
    assert by[2].sentence_share == 0 and by[2].symbol_ratio > 0.1 and by[2].group_lang == "en"
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].sentence_share == 1
    assert by[None].group_lang == "de" and by[7].sentence_share < 0.5 and by[8].n_words == 100_000
    scored = quality.prose_quality(docs(spark, rows), words).collect()
    assert len(scored) == len(rows)
    assert quality.prose_quality(docs(spark, []), words).count() == 0


def test_tails_like_brute_force(spark, words):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["the", "of", "Mill", "x#", "7"], rng.integers(1, 30))) + ("." if rng.random() < 0.5 else "") for _ in range(200)] + ["the mill"] * 100
    stats = quality.text_statistics(docs(spark, [doc(i, t) for i, t in enumerate(texts)]), words)
    got = {r.doc_id: r.outlier_score for r in quality.outlier_scores(stats).collect()}
    rows = stats.toPandas().set_index("doc_id")
    left, right, auto = defaultdict(float), defaultdict(float), defaultdict(float)
    for s in quality.STATISTICS:
        for _, part in rows.groupby("group_lang"):
            v = part[s].to_numpy()
            dev = v - v.mean()
            skew = (dev**3).mean() / ((dev**2).mean() ** 1.5) if (dev**2).mean() > 0 else 0
            for i, x in part[s].items():
                a, b = -np.log((v <= x).mean()), -np.log((v >= x).mean())
                left[i] += a
                right[i] += b
                auto[i] += a if skew < 0 else b
    assert len(got) == 300
    for i in got:
        assert got[i] == pytest.approx(max(left[i], right[i], auto[i]), abs=1e-5)


def test_junk_that_fills_a_language_is_found(spark, words):
    table = "\n".join(f"Ab Cd | {i} | {i * 7}" for i in range(12))
    rows = [doc(i, table) for i in range(95)] + [doc(100 + i, f"{PROSE} It was so for {i} days.") for i in range(5)]
    got = {r.doc_id: r for r in quality.prose_quality(docs(spark, rows), words).collect()}
    assert all(got[i].is_prose == (i >= 100) for i in got) and len(got) == 100
    # Copies count once: the table is one of six different texts, with tails of a sixth.
    once = {r.doc_id: r.outlier_score for r in quality.prose_quality(docs(spark, rows[94:]), words).collect()}
    assert {i: got[i].outlier_score for i in once} == once
    same = [doc(i, table) for i in range(30)]
    assert not any(r.is_prose for r in quality.prose_quality(docs(spark, same), words).collect())


def test_the_score_decides(spark, words, monkeypatch):
    junk = [doc(i, "\n".join(f"Ab{k} Cd | {k} | {i * 7}" for k in range(6 + i % 5))) for i in range(12)]
    mixed = [doc(50 + i, f"{PROSE} It is {i}.\n" + "\n".join(["the mill and the road"] * 6)) for i in range(4)]
    rows = junk + mixed + [doc(100 + i, f"{PROSE} It was so for {i} days.") for i in range(40)]
    got = {r.doc_id: r for r in quality.prose_quality(docs(spark, rows), words).collect()}
    assert all(not got[i].is_prose for i in range(12)) and all(got[i].is_prose for i in range(50, 140) if i in got)
    few = quality.prose_quality(docs(spark, rows), words, tuple(quality.HALF_PROSE)).collect()
    assert {r.doc_id: (r.is_prose, r.junk_score) for r in few} == {i: (r.is_prose, r.junk_score) for i, r in got.items()}
    monkeypatch.setattr(quality, "PROSE_SHARE", 2.0)  # without the check the score alone
    assert {r.doc_id for r in quality.prose_quality(docs(spark, rows), words).collect() if not r.is_prose} == set(range(12))


def key(line):
    return "".join(c for c in line.upper().lower() if unicodedata.category(c)[0] in "LM")


def test_repeated_lines_like_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    lines = [f"Share this story number {i} with friends" for i in range(3)] + ["Straße frei", "STRASSE  FREI!", "123 456", "", "share this STORY number 9 with friends", "One  line", "Listen to the story of Ann", "Listen to the story of Bob"]
    rows = []
    for i in range(60):
        own = [lines[k] for k in rng.integers(0, len(lines), 6)] + [f"unique line of text {chr(97 + i % 26)}{chr(97 + i // 26)} here"]
        rows.append(doc(i, "\n".join(own), source=None if i % 7 == 0 else ("s" if i % 3 else "t"), url=f"https://WWW.{'s' if i % 2 else 't'}:80/x" if i % 7 == 0 else None))
    rows += [doc(100, None), doc(None, lines[0]), doc(102, lines[0], source=None), doc(103, "", source=" "), doc(5, rows[5][1], source=rows[5][3], url=rows[5][4])]
    seen = defaultdict(set)
    where = []
    for r in rows:
        site = (r[3] or "").strip() or (r[4] and r[4][12:13].lower())
        if not site or r[1] is None or r[0] is None:
            continue
        for n, line in enumerate(r[1].split("\n")):
            if key(line):
                seen[site, key(line)].add(r[0])
                where.append((r[0], n, site, key(line)))
    expected = {(i, n) for i, n, s, k in where if len(seen[s, k]) >= 5}
    got = [(r.doc_id, r.line_no) for r in repeats.repeated_lines(docs(spark, rows)).collect()]
    assert set(got) == expected
    cleaned = {r.doc_id: r for r in repeats.without_repeated_lines(docs(spark, rows), near=False).collect()}
    assert cleaned[100].text is None and cleaned[102].removed == 0
    assert cleaned[1].text == "\n".join(s for n, s in enumerate(rows[1][1].split("\n")) if (1, n) not in expected)
    assert repeats.repeated_lines(docs(spark, [])).count() == 0
    monkeypatch.setattr(repeats, "SENT_KEYS", 0)
    joined = {r.doc_id: r for r in repeats.without_repeated_lines(docs(spark, rows), near=False).collect()}
    assert {i: (r.text, r.removed) for i, r in joined.items()} == {i: (r.text, r.removed) for i, r in cleaned.items()}


def test_large_buckets_are_split(spark, monkeypatch):
    base = [chr(97 + i % 26) * 3 + chr(97 + i // 26) for i in range(40)]
    rows = []
    for i in range(24):
        own = list(base)
        own[i % 3] = "z" + chr(97 + i)  # one to three shingles of 36 differ
        rows.append(doc(i, " ".join(own[::-1] if i % 4 == 3 else own)))
    want = sorted(map(tuple, repeats.line_frequencies(docs(spark, rows)).collect()))
    monkeypatch.setattr(repeats, "GROUP", 2)
    monkeypatch.setattr(repeats, "HEADS", 2)
    assert sorted(map(tuple, repeats.line_frequencies(docs(spark, rows)).collect())) == want and {r[2] for r in want} == {18, 6}


@pytest.mark.parametrize(("group", "heads"), [(2, 2), (7, 1), (3, 64)])
def test_no_link_of_a_large_bucket_is_lost(spark, monkeypatch, group, heads):
    """Each line is like its neighbours in a chain and like no other, so every link counts; with one band no other bucket makes up for one."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(letters, 7)) for _ in range(110)]
    rows = []
    for chain in range(2):
        own = list(words)
        own[100 + chain] = "other"
        for i in range(45):
            rows.append(doc(len(rows), " ".join(own)))
            own[5 + 2 * i] = "".join(rng.choice(letters, 7))
    rows += [doc(len(rows) + i, " ".join(words[:60] + ["".join(rng.choice(letters, 7)) for _ in range(40)])) for i in range(30)]
    want = sorted(map(tuple, repeats.line_frequencies(docs(spark, rows), min_docs=1, bands=1).collect()))
    assert len(want) == len(rows) and len({r[2] for r in want}) > 2
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "HEADS", heads)
    assert sorted(map(tuple, repeats.line_frequencies(docs(spark, rows), min_docs=1, bands=1).collect())) == want


def test_filter_keeps_its_members(spark):
    ids = np.random.default_rng(6).integers(-(1 << 62), 1 << 62, 3000)
    bits = repeats.id_filter(spark.createDataFrame([(int(i),) for i in ids[:1000]], "id long"))
    hit = repeats._may_be_in(ids, bits)
    assert hit[:1000].all() and hit[1000:].mean() < 0.01


def test_same_letters_in_other_case_are_one_line(spark):
    rows = [doc(i, s) for i, s in enumerate(["the big cat sat on a mat", "the Big cat sat on a mat", "the big Cat sat on a mat", "the big cat Sat on a mat", "The Big Cat sat on a Mat"])]
    assert {r.doc_id for r in repeats.repeated_lines(docs(spark, rows)).collect()} == set(range(5))


def test_documents_are_counted_not_lines(spark):
    names = ["Ann", "Bob", "Cid", "Dan", "Eve"]
    rows = [doc(1, "\n".join(f"the story of {n} is told in the town hall on a quiet day" for n in names)), doc(2, "the story of Fay is told in the town hall on a quiet day")]
    got = repeats.without_repeated_lines(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.removed) for r in got) == [(1, 0), (2, 0)]
    rows += [doc(10 + i, f"the story of {n} is told in the town hall on a quiet day") for i, n in enumerate(["Gil", "Hal", "Ida"])]
    assert sorted((r.doc_id, r.removed) for r in repeats.without_repeated_lines(docs(spark, rows)).collect()) == [(1, 5), (2, 1), (10, 1), (11, 1), (12, 1)]


def test_recall_of_near_duplicate_clusters(spark):
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows, n = [], 0
    for site in range(300):
        base = ["".join(rng.choice(letters, 6)) for _ in range(60)]
        for k in range(5):
            own = list(base)
            if k:  # a word near an end changes two of 56 shingles, one at an end one: similarities of 0.8 and more
                own[int(rng.integers(0, 3))] = "".join(rng.choice(letters, 7))
                own[-1 - int(rng.integers(0, 3))] = "".join(rng.choice(letters, 7))
            rows.append(doc(n, " ".join(own), source=f"s{site}"))
            n += 1
    got = repeats.line_frequencies(docs(spark, rows)).where("cluster_docs = 5").count()
    assert got >= 0.98 * n


def test_near_duplicate_lines_are_clustered(spark):
    rows = [doc(i, f"please {'do ' if i % 2 else ''}read the full terms of use on the page of our partner before you go on to buy number {i}") for i in range(6)]
    got = {(r.doc_id, r.line_no): r for r in repeats.line_frequencies(docs(spark, rows)).collect()}
    assert len(got) == 6 and all(r.line_docs == 3 for r in got.values())
    x = repeats.Lines(["a b c d e f g\nA 1\na  B b-c (d) 2 e f 9 H", "A b! C2 d e F g"], np.array([1, 1]))
    assert x.doc.tolist() == [0, 0, 0, 1] and x.place.tolist() == [0, 1, 2, 0] and x.sizes.tolist() == [7, 0, 6, 4]
    assert x.key[0] == x.key[3] != x.key[2] and x.line[0] != x.line[3] and x.line[1] == x.key[1]
    s, n = x.shingles(np.array([0, 2]))
    assert n.tolist() == [3, 2] and s[0] == s[3] and s[1] == s[4] and s[2] not in s[3:]


@pytest.mark.parametrize(("a", "b", "same"), [("Straße", "STRASSE", True), ("a\u0301b", "a b", False), ("Σας", "σΑΣ", True), ("x² y", "X Y", True), ("ab", "ba", False), ("𐐀a", "𐐨A", True), ("ﬁn", "FIN", True), ("", "12", True)])
def test_keys_of_letters(a, b, same):
    x = repeats.Lines([a, b], np.array([5, 5]))
    assert (x.key[0] == x.key[1]) == same and (x.has[0] == x.has[1])


def test_clusters_are_whole_over_buckets(spark):
    # A chain: each line is similar to its neighbours only, so no bucket and no representative holds all five.
    words_ = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}{x}" for i, x in enumerate("q" * 80)]
    rows = [doc(i, " ".join(words_[3 * i : 3 * i + 44])) for i in range(5)] + [doc(9, " ".join(words_[60:]))]
    got = {r.doc_id: r.cluster_docs for r in repeats.line_frequencies(docs(spark, rows)).collect()}
    assert got == dict.fromkeys(range(5), 5)
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(40, 30)], "a long, b long")
    assert {r.key: r.cluster for r in repeats.components(links).collect()} == dict.fromkeys(range(1, 21), 1) | {30: 30, 40: 30}


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (f"{PROSE} {{{{ city }}}} {PROSE}", "placeholder"), ("Dear %first_name%,\nwelcome", "placeholder"), ("x [INSERT COMPANY] y", "placeholder"), ("x ${user.email} y", "placeholder"), ("TODO: nickname is here", "placeholder"), ("[Your headline for X goes here]", "placeholder"),
        ("Insert the introduction of Ann Lee here.", "filler"), ("MUSTERTEXT FÜR X Y, BITTE NICHT VERÖFFENTLICHEN.", "filler"), ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"),
        ("Error 404: the page /x/y could not be found on this server.", "notice"), ("Zet JavaScript aan om X te lezen.", "notice"), ("Access  denied. You do not have permission to view this page.\nAb Cd / 0a1b2c", "notice"), ("Home | News\nPlease enable JavaScript to continue.\n© 2024 X. All rights reserved.", "notice"),
        (PROSE, None), ("Please enable JavaScript to continue.\n" + PROSE, None), ("The manual prints the line `echo ${HOME}` as an example.", None), ("Printers used meaningless Latin as filler.", None), ("", None), (None, None), ("1 < 2 and <b>bold</b> {0, 1}", None), ("% and %d%% of [1] items", None),
    ],
)
def test_residue(text, reason):
    found = residue.judge(text)
    assert (found and found[0]) == reason


def test_notices_in_long_lines():
    parts = ["Error 404: the page /x/y could not be found on this server.", "Access denied. You do not have permission to view this page.", "Please enable JavaScript to continue.", "Zet JavaScript aan om X te lezen."] * 3
    one = " ".join(parts)
    assert len(one) > 260 and residue.judge("\n".join(parts))[0] == residue.judge(one)[0] == "notice"
    assert prose.notice(one) and quality.LineReader({}).sentence(one, one.lower().split())
    assert residue.judge(f"{PROSE} {PROSE} {PROSE} {parts[1]}") is None and not prose.notice(f"{PROSE} {PROSE} {PROSE} {parts[1]}")
    assert residue.judge(f"{PROSE} " * 3000) is None and residue.judge("x" * 5000) is None


def test_residue_of_tables(spark):
    rows = spark.createDataFrame([(1, "{{ x_y }}", PROSE, "a"), (2, None, "Service unavailable", "b"), (3, "", None, "c"), (None, "{{ x_y }}", None, "d"), (4, PROSE * 3000, None, "e")], "item_id long, text string, content string, row_id string")
    got = sorted((r.row_id or 0, r.field, r.reason) for r in residue.residue(rows, "item_id", ("text", "content")).collect())
    assert got == [(0, "text", "placeholder"), (1, "text", "placeholder"), (2, "content", "notice")]
    assert sorted(r.item_id or 0 for r in residue.without_residue(rows, "item_id", ("text", "content")).collect()) == [0, 3, 4]
    assert residue.residue(rows.limit(0), "item_id").count() == 0


PAGE = ["This site stores small files on your device. Accept all or manage your settings.", "Home | About us | Help", "", "Home > Help » The story of A and B", "The story of A and B", PROSE + " It is so.", "Why A matters for B", PROSE + " It was so.", "- item one", "- item two", "Print this page", "You may also like", "What A learned from B", "B and the road to C", PROSE + " It will be so.", "© 2023 X. All rights reserved."]


def test_main_body(spark):
    text = "\n".join(PAGE)
    assert body.surrounding_lines(text, "The story of A and B") == [0, 1, 3, 10, 11, 12, 13, 15]
    assert body.surrounding_lines(text, None) == [0, 1, 3, 10, 11, 12, 13, 15]
    for nothing in (None, "", "\n\n", PROSE, "Home | News\nPlease enable JavaScript to continue."):
        assert body.surrounding_lines(nothing) == []
    rows = spark.createDataFrame([(1, text, "The story of A and B", None, "x"), (2, None, None, PROSE * 2000, "x"), (1, text, None, text, "x")], "item_id long, content string, title string, text string, lines string")
    got = body.boilerplate(rows).collect()
    assert sorted((r.item_id, r.field, len(r.lines)) for r in got) == [(1, "content", 8), (1, "content", 8), (1, "text", 8)]
    kept = {(r.item_id, r.field): r.body for r in body.main_body(rows.limit(2)).collect()}
    assert kept[2, "content"] is None and kept[1, "content"].split("\n") == [s for i, s in enumerate(PAGE) if i not in (0, 1, 3, 10, 11, 12, 13, 15)]
    assert len(kept) == 4 and kept[1, "text"] is None and kept[2, "text"] == PROSE * 2000
    assert body.boilerplate(rows.limit(0)).count() == 0


def test_regions_decide(monkeypatch):
    text = "\n".join(PAGE)
    for inside in (True, False):
        monkeypatch.setattr(body, "regions", lambda ratio, kinds: [inside] * len(kinds))
        assert len(set(body.surrounding_lines(text, PAGE[4])) & {0, 1, 3, 10, 11, 12, 13, 15}) in (0, 8) and body.surrounding_lines(text, PAGE[4]) != [0, 1, 3, 10, 11, 12, 13, 15]


def test_unknown_menus_are_found_by_their_place():
    page = ["Etusivu", "Uutiset", "Urheilu", "Kulttuuri", "Mylly ja tie", "Vanha mylly on kaupungin laidalla, ja tie laaksoon oli talvella poikki lumen takia. Nyt se on auki.", "Se on auki taas ensi viikolla, kun lumi on sulanut ja tie kuivunut.", "Tie B", "Tori C"]
    assert body.surrounding_lines("\n".join(page)) == [0, 1, 2, 3, 7, 8]


def test_pages_of_markup(spark):
    html = f"<html><head><title>The old mill</title><script>var a = '<p>no</p>';</script></head><body><nav><a href=x>Etusivu</a> <a href=y>Uutiset</a></nav><!-- x --><h1>The old mill</h1><p>{PROSE}<p>{PROSE} <b>Now</b> &amp; then.</p><ul><li>one of the &eacute;ntries<li>two of the entries</ul><aside>Something else here</aside><footer>Nothing of the kind</footer>"
    rows = spark.createDataFrame([(1, html, "a"), (2, None, "b"), (3, "", "c"), (None, "<p>" + PROSE * 3000, "d")], "page_id long, html string, body string")
    got = {r.page_id: r.body for r in body.page_bodies(rows).collect()}
    assert got[1].split("\n") == ["The old mill", PROSE, f"{PROSE} Now & then.", "one of the éntries", "two of the entries"]
    assert got[2] is None and got[3] == "" and len(got[None]) > 1000 and body.page_bodies(rows.limit(0)).count() == 0


EVERYDAY = """Subscribe to our newsletter | Share on Facebook | This website uses cookies to improve your experience. | Related articles | Leave a comment | About / Careers / Press | Follow us on Twitter | Read more | Abonnieren Sie unseren Newsletter | Partager sur Facebook | Deja un comentario | Condividi su Twitter"""
MESSAGES = """403 Forbidden | Coming soon | Checking your browser before accessing example.com. | You need to enable JavaScript to run this app. | Error 500: internal server error | Page not found | Bad gateway | Sorry, you have been blocked | Just a moment... | Diese Seite existiert nicht | Página en construcción | Too many requests"""


@pytest.mark.parametrize("line", EVERYDAY.split(" | "))
def test_everyday_surroundings(line):
    assert prose.surrounding(line.replace(" / ", " | "))


@pytest.mark.parametrize("line", MESSAGES.split(" | "))
def test_everyday_messages(line):
    assert residue.judge(line)[0] == "notice" and residue.judge(f"{PROSE} {PROSE}\n{line}") is None


@pytest.mark.parametrize("line", [PROSE, "The library keeps a record of all the cookies that a site sets in a browser, and of what they are for.", "The mill press was sold to a category of people who follow the old ways of the valley."])
def test_content_is_no_surrounding(line):
    assert prose.surrounding(line) == 0 and residue.judge(line) is None


def test_length_is_no_switch():
    cookie = "We use cookies and similar technologies on this website. You can view our privacy policy and change your settings. All rights reserved. Subscribe to our newsletter."
    long = " ".join([cookie] * 12)
    assert prose.surrounding(cookie) == prose.surrounding(long) == prose.SURROUNDING
    assert prose.surrounding(f"{PROSE} {PROSE} {PROSE} All rights reserved.") == 0
    far = "Sample text for " + "the very long name of somebody " * 20 + "please do not publish"
    assert residue.judge(far)[0] == "filler" and residue.judge("[INSERT " + "X " * 200 + "]")[0] == "placeholder"
    assert residue.judge("La receta <title> es de ayer")[0] == "placeholder" and residue.judge("The page has <title>a b</title> in it") is None


def test_regions_of_markup():
    html = "<nav><a href=x>a</a> <a href=y>b</a> <a href=z>c</a></nav>\n<nav><a href=x>d</a> <a href=x>e</a> <a href=x>f</a></nav>\n" + "\n".join(f"<p>{PROSE}</p>" for _ in range(5)) + "\n<footer><a href=x>a</a><a href=x>b</a><a href=x>c</a></footer>"
    lines = html.split("\n")
    kinds = [prose.OTHER] * len(lines)
    assert body.regions(body.ratios(html, lines, kinds), kinds) == [False, False] + [True] * 5 + [False]


def test_lexicon_has_plain_forms():
    assert "seite drucken" in lexicon.phrases(lexicon.SURROUNDINGS) and "sigue mas abajo" in lexicon.phrases(lexicon.SURROUNDINGS)
    assert all(len(s) >= 4 for s in lexicon.latin_stems())
    assert all(len(list(itertools.islice(b.split("|"), 400))) < 400 for b in (lexicon.SURROUNDINGS, lexicon.NOTICES))


def test_notices_and_surroundings_without_known_phrases():
    for s in ("This server denied access to the account.", "Der Zugriff auf die Seite ist gesperrt.", "Votre navigateur doit activer les scripts.", "Activa los scripts del navegador y recargue la página."):
        assert residue.judge(s)[0] == "notice" and residue.judge(f"{PROSE}\n{PROSE}\n{s}") is None
    assert residue.judge(f"{PROSE} The page on the server was blocked.") is None


@pytest.mark.parametrize("text", ["sample text for x " * 20_000, "[INSERT " * 50_000, "Some heading here\n" * 50_000, "- ab\n" * 50_000, "{{name}} `x " * 20_000, "Access denied. You may not view this page. " * 10_000, "All rights reserved. Read more. " * 10_000])
def test_long_texts_take_time_in_proportion(text):
    start = time.perf_counter()
    body.surrounding_lines(text)
    residue.judge(text)
    assert time.perf_counter() - start < 10
