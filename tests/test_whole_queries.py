"""Queries that must reach every row of their tables, against brute force in Python."""

import random

from foliant import constants as K
from foliant.plans.catalog import QUERIES

ITEMS = [(3, "alpha river bridges carry heavy stone carts today and more"), (4, "winter garden lamps glow beside quiet frozen ponds"), (15, "copper kettles whistle above seven kitchen stoves nightly"), (26, "never seen words stand here without any partner"), (37, "abc")]
DOCS = [(10, f"so {ITEMS[0][1]}"), (23, "river bridges"), (31, f"first {ITEMS[1][1]}"), (44, f"second {ITEMS[1][1]}"), (58, "copper kettles whistle above kitchen stoves nightly seven"), (65, "copper kettles glow"), (72, "abc"), (80, "")]


def tables(spark, folder):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")


def scored():
    out = []
    for i, item in ITEMS:
        title = item.split(".")[0]
        tokens = [t for t in title.split() if len(t) > 2 and t not in K.STOPWORDS]
        for d, page in DOCS:
            share = len(set(tokens) & set(page.split())) / len(set(tokens)) if len(tokens) >= K.TITLE_TOKENS else 0.0
            out.append((i, d, 0.0 if len(title) < K.TITLE_CHARS else 1.0 if title in page else share, title in page))
    return out


def test_titles_meet_all_documents(spark, tmp_path):
    tables(spark, tmp_path)
    pairs = scored()
    rows = lambda name: {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert rows("title_candidates") == {(i, d) for i, d, _, exact in pairs if exact}
    assert rows("title_match_score") == {(i, d, round(s, 6)) for i, d, s, _ in pairs if s > 0.4}
    want = set()
    for i, _ in ITEMS:
        mine = sorted(((s, d) for k, d, s, _ in pairs if k == i), reverse=True)
        exact = [d for k, d, _, e in pairs if k == i and e]
        clear = mine[0][0] >= K.TITLE_SCORE and mine[0][0] - mine[1][0] >= K.TITLE_LEAD
        want.add((i, exact[0], 1.0) if len(exact) == 1 else (i, mine[0][1] if clear else None, round(mine[0][0], 6)))
    assert rows("title_unique") == want


def test_sessions_hold_all_events(spark, tmp_path):
    rnd = random.Random(4)
    events = [(i, rnd.choice(["view", "buy", "rare"] if i % 400 < 100 else ["view"])) for i in range(2000) if not 500 <= i < 600]
    spark.createDataFrame(events, "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = []
    for kind in sorted({k for _, k in events}):
        for page in sorted(i for i, k in events if k == kind):
            if want and want[-1][0] == kind and page - want[-1][3] <= 40:
                want[-1][3:] = [page, want[-1][4] + 1]
            else:
                want.append([kind, want[-1][1] + 1 if want and want[-1][0] == kind else 0, page, page, 1])
    got = sorted(list(r) for r in QUERIES["page_sessions"](spark, str(tmp_path)).collect())
    assert got == want and sum(r[4] for r in got) == len(events)
