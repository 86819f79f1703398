"""What is quoted at the first level is what a message answers."""

from graphloom.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"
TALK = [
    (1, 0, "u", "A long question of many more words than its answer has\nwith a second line"),
    (1, 1, "a", "> A long question of many more words than its answer has\n> with a second line\nYes."),
    (1, 2, "u", ">> A long question of many more words than its answer has\n>> with a second line\n> Yes.\nThanks"),
    (1, 3, "a", ">> A long question of many more words than its answer has\n> never said\nonly the deeper one is known"),
]


def test_first_level_decides(spark):
    df = spark.createDataFrame(TALK, SCHEMA)
    told = {r["turn"]: (r["parent_turn"], r["by"], r["depth"]) for r in quotes.linked(df).collect()}
    assert told == {0: (None, None, 0), 1: (0, "quote", 1), 2: (1, "quote", 2), 3: (0, "quote", 1)}
