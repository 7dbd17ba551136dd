"""Small fixture tables with hard cases, and brute-force forms."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long, h string, g string, family string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", str(r.randint(0, 99))]) for _ in range(n))


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty, tiny, periodic and accented texts; clashing extra columns."""
    base, other, passage = prose(1, 120), prose(2, 150), prose(3, 60)
    near = base.split()
    near[60] = "changed"
    texts = {
        0: base, 1: base, 2: " ".join(near), 3: other, 4: passage + "\n" + prose(4, 80), 5: prose(5, 70) + "\n" + passage, 6: None, 7: "",
        8: "one", 9: "one two three four", 10: "w " * 300, 11: "é" * 250 + " " + passage, 12: "ab" * 500, 13: prose(6, 2000), 14: "   \n\t ",
        15: "One  TWO three\tfour", 16: base[:150] + " " + prose(7, 40), 17: base.upper(), 18: prose(8, 30) + " " + base[100:450],
    }
    out = [(k, t, "en" if k % 2 else None, f"src{k % 3}" if k % 5 else None, None if t is None else len(t), "h", "g", "f") for k, t in texts.items()]
    out.append(out[3])  # a repeated row
    out.append((None, other, "fr", "src1", 3, "h", "g", "f"))
    return out


def documents(spark, rows=None, parts: int = 3):
    return spark.createDataFrame(corpus() if rows is None else rows, DOC).repartition(parts)
