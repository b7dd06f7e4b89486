from recollect.llm import chat


def test_prefixes_and_copies_collapse(spark):
    turns = []
    add = lambda c, *t: turns.extend((c, i, r, x, "n", "p") for i, (r, x) in enumerate(t))
    hi, yes, more = ("user", "hi"), ("assistant", "yes"), ("user", "more")
    add(1, hi)
    add(2, hi, yes)
    add(3, hi, yes, more)
    add(4, hi, yes, more)
    add(5, hi, ("assistant", "no"))
    add(6, ("user", None), (None, "x"))
    add(None, ("user", "alone"))
    add(7, ("user", "x y"), ("user", "z"))
    add(8, ("user", "x"), ("user", "y z"))
    turns += [(9, 0, "user", "twice", "n", "p")] * 2
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, last string, prints string")
    found = {r.conv_id: r for r in chat.render(chat.collapse(frame)).collect()}
    assert set(found) == {3, 5, 6, None, 7, 8, 9}
    assert found[3].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert found[6].rendered == "<|im_start|>user\n<|im_end|>\n<|im_start|>\nx<|im_end|>\n"
    assert found[9].n_turns == 2
    assert chat.collapse(frame.limit(0)).count() == 0


def test_long_conversation(spark):
    turns = [(c, i, "user", "y" * 2_000) for c, n in ((1, 300), (2, 299)) for i in range(n)]
    found = chat.collapse(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.conv_id, r.n_turns) for r in found] == [(1, 300)]


def test_rolling_hashes_at_the_parts_borders(spark):
    """Hashes of each prefix, one after another, for conversations around the length of a part."""
    import hashlib

    turns = [(n, i, "user", f"t{i}") for n in (1, 255, 256, 257, 513) for i in range(n)]
    rows = chat.conversations_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    for r in rows:
        prints, last = [], ""
        for i in range(r.conv_id):
            last = hashlib.md5(f"{last} 4 user t{i}".encode()).hexdigest()
            prints.append(last)
        assert r.prints == prints
    kept = chat.collapse(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert [r.conv_id for r in kept] == [513]
