"""Documents with the awkward cases that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, copies int, bucket int"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def documents(seed: int = 5) -> list[tuple]:
    """Nulls, empty and long texts, copies, near copies, shared passages, repeated rows and clashing extra columns."""
    rng = random.Random(seed)
    base = prose(rng, 300)
    words = base.split()
    near = words.copy()
    near[150] = "zzz"
    passage = prose(rng, 60)
    texts = [None, "", " \t\n", "one", "two words", base, base, "  " + base.replace(" ", "  "), base.upper(), " ".join(near), prose(rng, 20000)]
    texts += [f"{prose(rng, 40)}\n{passage} {prose(rng, 30)}" for _ in range(4)]
    texts += [passage + " " + passage, "<|endoftext|> in text", "ΑΣ Σ ÉÄ́ \x1c x y", "4111 1111 1111 1111 on 2024-02-29"]
    texts += [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "S3", "é"][i % 5], None, "k", 1, 2, 3) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[0]]
