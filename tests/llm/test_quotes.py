import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trailweave.llm import quotes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path int"


def ordered(spark, rows):
    return quotes.reply_ordered(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()


def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "user", "How do I read a file?\n\nIt is a long one."),
        (1, 1, "assistant", "Use open().\nThen read lines."),
        (1, 2, "user", "> Use open().\n> Then read lines.\nThat works, thanks."),
        (1, 3, "assistant", "On Monday, A wrote:\n>> how do I READ  a file\n> use open()\n> Then read, lines!\n>\nOr use a generator."),
        (1, 4, "user", ">>> How do I read a file?\n>> Use open().\n> That works, thanks.\n\nSee above > here."),
        (1, 5, "assistant", "> It is a long one.\nHow long?"),
        (1, 6, "user", "> Nobody said this.\nIndeed."),
        (2, 0, "user", "> Use open().\nOther conversation."),
    ]
    got = {(r.conv_id, r.turn): r for r in ordered(spark, rows)}
    assert [got[1, t].reply_to for t in range(7)] == [None, 0, 1, 1, 2, 0, 5]
    assert [got[1, t].quotes for t in range(7)] == [False, False, True, True, True, True, False]
    assert got[1, 3].text == "Or use a generator." and got[1, 4].text == "See above > here." and got[2, 0].reply_to is None
    assert got[1, 2].text == "That works, thanks." and got[1, 6].text == "> Nobody said this.\nIndeed."


def test_deeper_quotes_link_and_what_is_not_linked_stays(spark):
    rows = [
        (1, 0, "user", "The first question, with some words."),
        (1, 1, "assistant", "An answer to it."),
        (1, 2, "user", "Something else."),
        (1, 3, "assistant", ">> The first question, with some words.\nTo that I'd say more."),
        (1, 4, "user", "run this:\n> print(x)\n> Note: keep it"),
        (1, 5, "user", "On Monday A wrote:\n> An answer to it.\n>\n> and what nobody said\n\nYes.\n> $ ls\nNo."),
        (1, 6, "user", "> Note: keep it"),
    ]
    got = {r.turn: r for r in ordered(spark, rows)}
    assert [got[t].reply_to for t in range(7)] == [None, 0, 1, 0, 3, 1, 5]
    assert got[3].text == "To that I'd say more." and got[4].text == rows[4][3] and got[6].text == rows[6][3]
    assert got[5].text == ">\n> and what nobody said\n\nYes.\n> $ ls\nNo."


def brute(rows):
    """Links by going through the messages of a conversation one after another."""
    def norm(t):
        return " ".join(re.findall(r"[^\W_]+", t.lower()))

    out = {}
    for conv in {r[0] for r in rows}:
        talk = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        said = {}
        for k, (_, turn, _, text) in enumerate(talk):
            lines = text.split("\n")
            depth = [len(re.sub("[^>]", "", re.match(r"(?:[ \t]*>)*", x)[0])) for x in lines]
            votes, gone, i = Counter(), set(), 0
            while i < len(lines):
                j = i
                while j < len(lines) and depth[j] == depth[i]:
                    j += 1
                if depth[i]:
                    for size, (a, b) in [(2, (i, j)), *((1, (x, x + 1)) for x in range(i, j))]:
                        words = norm(" ".join(re.sub(r"^(?:[ \t]*>)+", "", x) for x in lines[a:b]))
                        if words and said.get(words, turn) < turn:
                            votes[-depth[i], said[words]] += size * len(words)
                            gone |= {*range(a, b)}
                i = j
            best = max(votes, key=lambda v: (v[0], votes[v], v[1]), default=None)
            parent = best[1] if best else talk[k - 1][1] if k else None
            left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            out[conv, turn] = (parent, best is not None, re.sub(r"^\s*\n|\s+$", "", left) if gone else text)
            own = re.sub(r"^\s*\n|\s+$", "", "\n".join(x for x, d in zip(lines, depth) if not d))
            for part in [own, *re.split(r"\n[ \t]*\n", own), *own.split("\n")]:
                if norm(part):
                    said.setdefault(norm(part), turn)
    return out


def test_links_against_brute_force(spark):
    r = random.Random(12)
    rows = []
    for conv in range(30):
        for turn in range(r.randrange(1, 9)):
            rows.append((conv, turn, "user", "\n".join(r.choice(("", "", "> ", ">> ", "> > > ")) + " ".join(r.choice("abc") for _ in range(r.choice((0, 1, 1, 2)))) for _ in range(r.randrange(1, 7)))))
    want = brute(rows)
    got = {(x.conv_id, x.turn): (x.reply_to, x.quotes, x.text) for x in ordered(spark, rows)}
    assert got == want and sum(q for _, q, _ in want.values()) > 30


@pytest.mark.parametrize("turns", [3, 1024])
def test_order_is_that_of_the_reply_tree(spark, monkeypatch, turns):
    monkeypatch.setattr(quotes, "_TURNS", turns)
    r = random.Random(turns)
    rows, want = [], []
    for conv in range(12):
        numbers = sorted(r.sample(range(-5, 60), r.randrange(1, 25)))
        parent = {}
        for k, t in enumerate(numbers):
            quoted = r.choice(numbers[:k]) if k and r.random() < 0.6 else None
            parent[t] = quoted if quoted is not None else numbers[k - 1] if k else None
            rows.append((conv, t, "user", (f"> message {conv} {quoted + 100}\n" if quoted is not None else "") + f"message {conv} {t + 100}"))

        def walk(t, conv=conv, numbers=numbers, parent=parent):
            want.append((conv, t, parent[t], f"message {conv} {t + 100}"))
            after = [u for u in numbers if parent[u] == t]
            # What goes on with the next turn comes first, then what leaves, in order of time; all else is further back.
            for u in after:
                walk(u)

        walk(numbers[0])
    r.shuffle(rows)
    assert [(x.conv_id, x.turn, x.reply_to, x.text) for x in ordered(spark, rows)] == want


def test_edge_cases(spark):
    rows = [(1, 0, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (1, 2, "user", "> "), (1, 2, "tool", "second piece"), (None, 1, "user", "> x\ny"), (1, None, "user", "z"), (1, 3, "user", "> second piece\nok"), (3, 5, "user", "word " * 200_000 + "\n"), (3, 6, "user", ("> " + "word " * 200_000 + "\n") + "x")]
    got = ordered(spark, rows)
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 3].reply_to == 2 and by[1, 3].quotes and by[3, 6].quotes and by[1, 0].text is None
    assert by[None, 1].text == "> x\ny" and by[None, 1].reply_to is None and by[1, None].text == "z"
    assert ordered(spark, []) == []


def test_given_conversations(spark):
    talks = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = quotes.reply_ordered(talks)
    assert sorted(map(tuple, got.select("conv_id", "turn", "role", "text").collect())) == sorted(map(tuple, talks.select("conv_id", "turn", "role", "text").collect()))
    assert got.filter("quotes").count() == talks.filter(F.col("text").rlike("(?m)^ *>")).count() == 0
