from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.splitting import cut_line, oversized_lines, split_items, split_text


def check(text, limit, overlap):
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    seen, before = {}, None
    for start, end, over, content in split_text(text, limit, overlap):
        assert len(content.encode()) <= limit
        if over:
            seen.setdefault(over, []).append(content)
        else:
            assert content == "\n".join(lines[start - 1 : end])
            if before and not before[2]:
                assert before[1] - start + 1 <= overlap and start <= before[1] + 1
            for n in range(start, end + 1):
                seen[n] = [lines[n - 1]]
        before = (start, end, over)
    assert ["".join(seen[n]) for n in sorted(seen)] == lines


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text("abc (){}é世 ", max_size=40), min_size=1, max_size=40), st.integers(12, 90), st.integers(0, 4))
def test_pieces_cover_the_text(lines, limit, overlap):
    check("\n".join(lines), limit, overlap)


def test_boundary_at_a_change_of_topic():
    a = "\n".join(f"apple pear plum cherry {'fruit ' * (i % 2)}basket" for i in range(12))
    b = "\n".join(f"engine wheel gear {'motor ' * (i % 2)}clutch brake" for i in range(12))
    pieces = split_text(a + "\n\n" + b, len(a) + 160, 0)
    assert pieces[0][1] in (12, 13)


def test_long_line_is_cut_between_characters():
    assert "".join(cut_line("世" * 100, 10)) == "世" * 100
    assert all(len(x.encode()) <= 10 for x in cut_line("世" * 100, 10))


def test_limits_and_lines(spark):
    limits = spark.createDataFrame([("go", 20, 1), ("default", 40, 1)], "language string, max_bytes int, overlap_lines int")
    files = spark.createDataFrame(
        [
            (1, "a\n" * 30, "GO", "x"),
            (1, "a\n" * 30, "GO", "x"),
            (2, "short", "go", "x"),
            (3, "b" * 50 + "\nc\n" + "d" * 60, None, "x"),
            (4, None, "go", "x"),
            (5, "", "go", "x"),
            (6, "e" * 41, "klingon", "x"),
        ],
        "file_id long, content string, language string, l string",
    )
    got = {(r["file_id"], r["line_no"]) for r in oversized_lines(split_items(files, limits, contents=False)).collect()}
    assert got == {(1, 0), (3, 1), (3, 3), (6, 1)}
    assert split_items(files.where("false"), limits).count() == 0
    assert split_items(files, limits.where("false")).count() == 0
