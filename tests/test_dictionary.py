"""Dictionary changes against a fold, one change after the other."""

import random

import pytest

from tidemark.operators import dictionary as D

WORDS = "id bigint, keyword string, normalized_keyword string, category string, active boolean, deleted boolean"
CHANGES = "seq bigint, action string, word string, new_word string"
ACTIONS = ("seed", "create", "rename", "rename", "rename", "activate", "deactivate", "delete")


def fold(words, changes):
    state = {w[2]: [w[0], w[1], w[3], w[4], bool(w[5])] for w in words}
    touched, rejected = set(), []
    for seq, action, word, new in sorted(changes):
        new = (new or "").strip() or None
        entry, reason = state.get(word), None
        touched |= {word, new if action == "rename" else word}
        if action == "seed":
            if entry is None:
                state[word] = [None, word, "manual", True, False]
            elif entry[2] == "general" and not entry[4]:
                entry[2] = "manual"
        elif entry and entry[2] == "auto":
            reason = "mined"
        elif action == "create":
            state[word] = [entry and entry[0], word, "manual", True, False]
        elif entry is None:
            reason = "unknown"
        elif action == "rename" and not new:
            reason = "empty"
        elif action == "rename" and new != word and new in state:
            reason = "conflict"
        elif action == "rename":
            del state[word]
            state[new] = [entry[0], new, "manual", *entry[3:]]
        else:
            entry[2:4] = ["manual", action == "activate"]
            entry[4] = entry[4] or action == "delete"
        if reason:
            rejected.append((seq, reason))
    return {(w, *map(str, e)) for w, e in state.items()}, rejected


def merged(spark, words, changes):
    kept, rejected = D.merge_dictionary(spark.createDataFrame(words, WORDS), spark.createDataFrame(changes, CHANGES).repartition(3))
    rows = [(r.normalized_keyword, *map(str, (r.id, r.keyword, r.category, r.active, bool(r.deleted)))) for r in kept.collect()]
    assert len(rows) == len(set(rows))
    return set(rows), sorted((r.seq, r.reason) for r in rejected.collect())


@pytest.mark.parametrize("seed, alphabet, n, chunk", [(1, "abcd", 60, 10_000), (2, "ab", 40, 3), (3, "abcdefgh", 150, 7), (4, "abcdefghijklmnop", 120, 50)])
def test_random_histories(spark, monkeypatch, seed, alphabet, n, chunk):
    monkeypatch.setattr(D, "CHUNK", chunk)
    rng = random.Random(seed)
    words = [(k, w.upper(), w, rng.choice(["manual", "general", "auto", "other"]), rng.choice([True, False, None]), rng.choice([True, False, None]))
             for k, w in enumerate(alphabet) if rng.random() < 0.5]
    changes = []
    for seq in rng.sample(range(-200, 2000), n):
        action = rng.choice(ACTIONS)
        changes.append((seq, action, rng.choice(alphabet), rng.choice([*alphabet, *alphabet, None, " "]) if action == "rename" else None))
    assert merged(spark, words, changes) == fold(words, changes)


def test_one_entry_renamed_many_times(spark):
    """A chain: what was set long ago still holds at its end, and the id stays."""
    words = [(7, "W0", "w0", "general", True, False)]
    changes = [(0, "deactivate", "w0", None)] + [(k + 1, "rename", f"w{k}", f"w{k + 1}") for k in range(9)] + [(20, "rename", "w3", "w4")]
    got = merged(spark, words, changes)
    assert got == fold(words, changes) and got[0] == {("w9", "7", "w9", "manual", "False", "False")}


def test_one_word_with_most_changes(spark, monkeypatch):
    """Renames to and from one word by turns, spread over many chunks, take few rounds."""
    monkeypatch.setattr(D, "CHUNK", 20)
    changes = []
    for k in range(60):
        changes += [(10 * k, "create", f"v{k}", None), (10 * k + 1, "rename", f"v{k}", "hot"), (10 * k + 2, "rename", f"v{k}", "hot")]
        if k % 3 == 0:
            changes.append((10 * k + 3, "rename", "hot", f"x{k}"))
        elif k % 3 == 1:
            changes.append((10 * k + 3, "deactivate", "hot", None))
    rounds = []
    scan = D._facts
    monkeypatch.setattr(D, "_facts", lambda df: rounds.append(1) or scan(df))
    assert merged(spark, [], changes) == fold([], changes)
    assert len(rounds) <= 6


def test_no_python_in_the_plan(spark):
    kept, rejected = D.merge_dictionary(spark.createDataFrame([(1, "a", "a", "manual", True, False)], WORDS),
                                        spark.createDataFrame([(1, "rename", "a", "b")], CHANGES))
    for df in (kept, rejected):
        assert "Pandas" not in df._jdf.queryExecution().toString() and "Python" not in df._jdf.queryExecution().toString()


def test_no_changes(spark):
    words = [(1, "a", "a", "manual", True, False)]
    assert merged(spark, words, []) == fold(words, [])
