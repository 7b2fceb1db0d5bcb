from __future__ import annotations

import random
from collections import Counter

from tables import same_rows

from quillbin.llm import line_rules
from quillbin.llm.words import Words


def test_same_rows_as_sql(spark, sf, duck):
    same_rows(line_rules.op8(spark, sf), duck.sql(line_rules.OP8_SQL))


def test_repeated_words():
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in range(300)] + [None, "", "a"]
    want = []
    for t in texts:
        w = (t or "").split()
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        want.append(len({i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}))
    assert Words(texts).repeated().tolist() == want
    assert Words([]).repeated().tolist() == []


def test_lines():
    good = "This is a line with a few words in it."
    text = "\n".join([good, "", "Home | About | News | Contact", "We use cookies. Read our Privacy Policy.", "BUY!! NOW!! NOW!!", good, "x", "a$$ b%% c## d&&", "Done already, then."])
    cleaned, lost, again = line_rules.clean(text)
    assert cleaned == f"{good}\nDone already, then."
    assert again == 1
    assert lost == sum(len(x.replace(" ", "")) for x in text.split("\n")) - len(cleaned.replace(" ", "").replace("\n", ""))


def test_odd_rows(odd_docs, odd_rows, no_docs):
    out = line_rules.judged(odd_docs).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in odd_rows)
    assert all(r["base_failed"] and not r["kept"] for r in out if r["n_words"] < 50)
    assert line_rules.judged(no_docs).count() == 0
