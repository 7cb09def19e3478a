import random
import re
from collections import Counter

from cartwright.llm import rule_ledger
from cartwright.llm.rule_ledger import CURRENT, POLICIES, RULES

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_upper": sum(c.isupper() for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_echoes": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


def failures(m):
    checks = [
        m["n_words"] < 10,
        100 * m["n_repeat_words"] > 20 * m["n_words"],
        100 * m["n_symbols"] > 5 * m["word_chars"],
        100 * m["n_dup_lines"] > 50 * m["n_lines"],
        100 * m["n_upper"] > 40 * m["word_chars"],
        100 * m["n_echoes"] > 30 * m["n_words"],
    ]
    return sum(1 << k for k, failed in enumerate(checks) if failed)


def texts():
    rng = random.Random(1)
    parts = ["a", "b", "c", "a", "The", "ABC", "x#", "|", "$$$", "é", "\n", "\n\n", "  ", "\t", "ß", "😀"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(300)]


def test_ledger_equals_brute_force(make, awkward):
    rows = awkward + [(100 + k, t, "en", "a", 0) for k, t in enumerate(texts())]
    entries = rule_ledger.ledger(make(rows, extra=True)).collect()
    by_id = {}
    for r in entries:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(entries) == len(rows)
    for i, text, *_ in rows:
        want = brute(text)
        assert any(
            {k: r[k] for k in want} == want and r.failures == failures(want) for r in by_id[i]
        ), (i, text, want)


def test_policies_and_ablations(make):
    rows = [(k, t, "en", "a", 0) for k, t in enumerate(texts())]
    entries = rule_ledger.ledger(make(rows))
    marks = [failures(brute(t)) for _, t, *_ in rows]
    for version, names in POLICIES.items():
        mask = rule_ledger.mask(names)
        assert entries.where(rule_ledger.fails(version)).count() == sum(m & mask != 0 for m in marks)
    chosen = rule_ledger.mask(POLICIES[CURRENT])
    got = {r.rule: r for r in rule_ledger.ablations(entries).collect()}
    for k, rule in enumerate(RULES):
        bit = 1 << k
        assert got[rule.name].n_failed == sum(m & bit != 0 for m in marks)
        assert got[rule.name].n_alone == sum(m & chosen == bit for m in marks)
        assert got[rule.name].n_rejected_without == sum(m & chosen & ~bit != 0 for m in marks)


def test_empty_table(make):
    entries = rule_ledger.ledger(make([]))
    assert entries.collect() == [] and rule_ledger.ablations(entries).collect() == []
