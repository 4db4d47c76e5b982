from collections import Counter, defaultdict

from patchlore.llm import lines
from tests.llm.conftest import CLASHES


def brute(rows, ratio, least):
    pages, total = defaultdict(set), defaultdict(set)
    for _, text, _, host in rows:
        if host is not None and text is not None:
            total[host].add(text)
            for x in text.split("\n"):
                if x.strip(" \t\r"):
                    pages[host, x.strip(" \t\r")].add(text)
        elif host is not None:
            total[host]
    bad = {k for k, p in pages.items() if len(p) >= least and len(p) > ratio * len(total[k[0]])}
    out = []
    for i, text, _, host in rows:
        kept = None if text is None else [x for x in text.split("\n") if (host, x.strip(" \t\r")) not in bad]
        out.append((i, text if text is None else "\n".join(kept), 0 if text is None else len(text.split("\n")) - len(kept)))
    return Counter(out)


def sample():
    rows = []
    for i in range(60):
        host = ["hot.example", "hot.example", "b.example", None][i % 4]
        rows.append((i, f"own line {i}\n  Subscribe now \t\n\nmiddle {i // 3}\nFooter {host}", "en", host))
    rows += [(100, None, None, "b.example"), (101, "", "en", "hot.example"), (102, "\n\n", "en", "hot.example"), (5, rows[5][1], "en", rows[5][3]), (None, "Subscribe now", None, "hot.example")]
    rows += [(200 + i, "an exact copy\nof one page", "en", "hot.example") for i in range(40)]
    rows.append((300, "\n".join(["Subscribe now"] * 3000 + ["end"]), "en", "hot.example"))
    return rows


def test_equals_brute_force(docs, monkeypatch):
    rows = sample()
    for ratio, least, per_task in ((0.1, 5, 50_000), (0.4, 2, 7), (0.95, 1, 3)):
        monkeypatch.setattr(lines, "ROWS_PER_TASK", per_task)
        table = docs(rows, CLASHES)
        got = lines.drop_boilerplate(table, ratio=ratio, min_pages=least)
        assert got.columns == [*table.columns, "lines_dropped"] and {tuple(r[c] for c in CLASHES) for r in got.collect()} == {(7,) * len(CLASHES)}
        assert Counter((r.doc_id, r.text, r.lines_dropped) for r in got.collect()) == brute(rows, ratio, least)


def test_copies_of_a_page_are_one_page(docs):
    rows = sample()
    got = {r.doc_id: r for r in lines.drop_boilerplate(docs(rows), min_pages=2).collect()}
    assert got[200].text == "an exact copy\nof one page" and got[200].lines_dropped == 0


def test_empty_table(docs):
    assert lines.drop_boilerplate(docs([])).count() == 0


def brute_by_rule(rows, rule):
    """As ``brute``, with numbers of their own for short lines."""
    def is_short(k):
        return len(k) < lines.SHORT_CHARS and k.count(" ") < lines.SHORT_WORDS
    pages, total = defaultdict(set), defaultdict(set)
    for _, text, _, host in rows:
        if host is not None and text is not None:
            total[host].add(text)
            for x in filter(None, (x.strip(" \t\r") for x in text.split("\n"))):
                pages[host, x].add(text)
    bad = {(h, k) for (h, k), p in pages.items() if len(p) >= (rule.short_pages if is_short(k) else rule.pages) and len(p) > (rule.short_ratio if is_short(k) else rule.ratio) * len(total[h])}
    return Counter((i, text if text is None else "\n".join(x for x in text.split("\n") if (host, x.strip(" \t\r")) not in bad)) for i, text, _, host in rows)


def test_pipeline_drops_rare_and_small_host_repeats(spark, docs, monkeypatch):
    import corpus_pipeline
    notice, motto = "Licensed to all who read these pages.", "So it goes."
    rows = [(i, f"an own line of page {i}" + (f"\n{notice}" if i < 8 else "") + (f"\n{motto}" if 200 <= i < 208 else "") + ("\nRead on" if 300 <= i < 320 else ""), "en", "big") for i in range(500)]
    rows += [(1000 + i, f"text of its own {i}\n{notice}", "en", "small") for i in range(3)]
    rows += [(2000 + i, f"one of two texts {i}\n{notice}", "en", "two") for i in range(2)] + [(3000, None, "en", "small"), (3001, f"x\n{notice}", "en", None)]
    for per_task in (50_000, 2):
        monkeypatch.setattr(lines, "ROWS_PER_TASK", per_task)
        got = corpus_pipeline.remove_boilerplate(spark, docs(rows), "").collect()
        assert Counter((r.doc_id, r.text) for r in got) == brute_by_rule(rows, lines.REPEATED)
    text = {r.doc_id: r.text for r in got}
    assert text[0] == "an own line of page 0" and text[1000] == "text of its own 0" and text[300] == "an own line of page 300"
    assert motto in text[200] and notice in text[2000] and notice in text[3001]
