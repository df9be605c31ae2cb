from test_packing_chat import brute_chats

from tidemark.llm import chat


def test_turns_with_the_same_number_are_placed_by_role_and_text(spark):
    rows = []
    for at in range(12):
        first, second = ("assistant", f"a {at}"), ("user", f"b {at}")
        # The short conversation holds the first of two rows of one turn as rendered, or the second, which is no beginning.
        rows += [(10 * at, 0, *first), (10 * at, 0, *second), (10 * at + 1, 0, *first), (10 * at + 2, 0, *second)]
    got = chat.rendered(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()
    assert sorted((row.conv_id, row.n_turns, row.n_copies, row.chat) for row in got) == brute_chats(rows)
    assert len(got) == 24
