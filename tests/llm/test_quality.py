import random
import re
from collections import Counter

from vigilflow.llm.quality import quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def test_counts_and_verdicts(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "bé", "c#", "🙂", "d"]) + r.choice([" ", "  ", "\n", "\t", "\x1c"]) for _ in range(r.randint(0, 80))) for _ in range(60)]
    texts += ["", None, " \n ", "a " * 50, "a b c d e f g h i j " * 400, "\x85 \xa0", "one two three four five six seven eight nine ten"]
    good = "these are ten or more words that do not fail a rule at all"
    rows = [(i, t, "mixed") for i, t in enumerate(texts)] + [(100 + i, good, "good") for i in range(300)] + [(1000 + i, "bad", "bad") for i in range(300)]
    rows += [(5000, good, "bad"), (5001, good, None), (5001, good, None), (None, good, "new")]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, n_words int")
    got = quality_rules(frame).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    for i, text in enumerate(texts):
        x = by[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == brute(text), (i, text)
    # One good page does not save a bad host; hosts with a row or two stand near the mean of all hosts.
    assert by[100]["kept"] and not by[5000]["kept"] and not by[1000]["kept"]
    assert by[100]["host_rate"] < by[5001]["host_rate"] < by[1000]["host_rate"]
    assert quality_rules(frame.limit(0)).collect() == []
