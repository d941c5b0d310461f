"""Small invented texts in three languages."""

import itertools

PARTS = {
    "en": (["The old kettle", "Our small garden", "This letter", "The neighbour's boat", "Each window"], ["needs another look", "was painted twice", "belongs to the other house", "came with a long list", "stays where it is"], ["before the winter", "near the river", "without any trouble", "at the end of the week"]),
    "de": (["Der alte Kessel", "Unser kleiner Garten", "Dieser Brief", "Das Boot des Nachbarn", "Jedes Fenster"], ["braucht noch einen Blick", "wurde zweimal gestrichen", "gehört zum anderen Haus", "kam mit einer langen Liste", "bleibt an seinem Platz"], ["vor dem Winter", "nahe am Fluss", "ohne jede Mühe", "am Ende der Woche"]),
    "zh": (["旧水壶", "我们的小花园", "这封信", "邻居的船", "每扇窗户"], ["还要再看一遍", "刷了两次漆", "属于另一座房子", "附有一张长清单", "留在原来的地方"], ["在冬天以前", "在河边", "没有任何麻烦", "到了周末"]),
}


def sentences(lang: str) -> list[str]:
    gap, stop = ("", "。") if lang == "zh" else (" ", ".")
    return [gap.join(p) + stop for p in itertools.product(*PARTS[lang])]


def texts(lang: str, n: int, length: int = 5) -> list[str]:
    """``n`` texts of ``length`` sentences each, no two alike."""
    every, gap = sentences(lang), "" if lang == "zh" else " "
    return [gap.join(every[(i * 7 + j * 13) % len(every)] for j in range(length)) for i in range(n)]
