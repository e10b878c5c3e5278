"""Small corpora with every case that operators must handle."""

import random


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    parts = ["the", "an", "Th", "ou", "ché", "ing", "er.", "ü", "on", "ti", "wh,", "re"]
    return " ".join("".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    base = prose(1, 300)
    words = base.split(" ")
    near = words.copy()
    near[40] = "changed"
    far = words.copy()
    for i in range(0, 300, 20):
        far[i] = f"w{i}"
    passage = prose(2, 90)
    return [
        (1, base),
        (2, base),
        (3, " ".join(near)),
        (4, " ".join(far)),
        (5, prose(3, 50) + "\n" + passage + "\n" + prose(4, 60)),
        (6, passage + " " + prose(5, 10) + " " + passage),
        (7, None),
        (8, ""),
        (9, " \t\n"),
        (10, "one two three"),
        (11, "One\ttwo THREE"),
        (12, "a" * 1500),
        (13, "ab" * 600),
        (14, prose(6, 20_000)),
        (15, prose(7, 30)),
        (15, prose(7, 30)),
        (None, base),
        (None, None),
        (16, "é" * 450),
        (17, "Mixed space here and  two  spaces \n x   y"),
        (18, "THE SAME WORDS HERE NOW"),
        (19, "the same words here now"),
    ]
