import re
from collections import Counter

from graphloom.llm.line_rules import clean_by_lines, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_repeated_words():
    docs = [b"a b c d e f g h".split(), [], ("a b c d e f g h " * 2).encode().split(), b"x ".split() * 30, ("p q r s t u v w z " + "p q r s t u v w y").encode().split()]
    assert repeated_words(docs).tolist() == [brute(w) for w in docs]


def test_counts_and_odd_rows(make, odd):
    got = {(r.doc_id, r.n_words): r for r in clean_by_lines(make(odd)).collect()}
    for key, text in odd:
        words = WORD.findall(text or "")
        r = got[key, len(words)]
        assert r.word_chars == sum(map(len, words)) and r.n_repeat_words == brute(words)
        assert r.base_failed == (len(words) < 20 or 100 * brute(words) > 30 * len(words))
    assert clean_by_lines(make([])).count() == 0


def test_lines_first(make):
    good = "This line has words enough to stand and ends with a mark.\nAnother one of the kind follows it, as it should in prose."
    bad = "Home | News | About | Contact\nAll rights reserved\nBUY NOW ONLY TODAY!! HURRY UP!!\n" + good
    rows = {r.doc_id: r for r in clean_by_lines(make([(1, good), (2, bad), (3, good + "\n" + bad * 2)])).collect()}
    assert rows[1].kept and rows[1].faults == [] and rows[1].clean_text == good
    assert not rows[2].kept and set(rows[2].faults) == {"navigation", "boilerplate", "capitals"} and rows[2].clean_text == good
    assert rows[3].n_dup_lines > 0
