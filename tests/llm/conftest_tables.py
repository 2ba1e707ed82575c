"""A conversation with nested quotes, wrapped quotes and edge rows."""

CHAT = [
    (1, 0, "user", "Shall we walk up the old mountain path tomorrow? I have maps."),
    (1, 1, "assistant", "> Shall we walk up the old\n> mountain path tomorrow?\nThe weather looks fine. Take water."),
    (1, 2, "user", "Something else: bring a coat."),
    (1, 3, "user", "Ann wrote:\n> > Shall we walk up the old mountain path tomorrow?\n> The weather LOOKS  fine.\nYes.\nBut when do we go?"),
    (1, 4, "assistant", ">> The weather looks fine.\n>Yes. But when do we go?\n\nAt nine."),
    (1, 5, "user", "> something else: bring a coat\nI will."),
    (1, 6, "user", "> Nobody ever said this sentence.\n> Nor that one.\nHm."),
    (2, 0, "user", "A first word."),
    (2, 1, "user", "> Shall we walk up the old mountain path tomorrow?\nOther conversation."),
    (2, 2, "user", None),
    (None, 4, "user", "> A first word."),
    (2, None, "user", "> A first word.\nAnd one without a turn."),
]
