"""Stop words: the English list, and lists of other languages from files."""

from __future__ import annotations

from pathlib import Path

# The English stop words of the standard analysis.
ENGLISH = """
a about above after again against all also am an and any are are aren't as at be because been before being below between both but by can't cannot
could couldn't did didn't do does doesn't don't down during for each either few for from further had gutenberg hadn't has hasn't hath have haven't
having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let let's
may me more most mustn't my myself no nor not now of off on once only or other ought our ours ourselves out over own quite s same shall shan't she
she'll she's should shouldn't so some such than that that's the their theirs then there them themselves then these thee they they'd they'll they're
they've this those thou through to together too under until unto up upon very us was wasn't we we'd we'll we're we've were weren't what what's when
when's where where's which while who who's whom why why's will with without won't would wouldn't ye you you'd you'll you're you've your yours yourself
yourselves
""".split()


def stop_words(language: str = "english", folder: str | None = None) -> list[str]:
    """The words of a language: English is built in, any other comes from <folder>/<language>.txt, one word a line."""
    if folder is not None:
        return [w.strip() for w in (Path(folder) / f"{language}.txt").read_text(encoding="utf-8").splitlines() if w.strip()]
    if language != "english":
        raise ValueError(f"no built-in stop words for {language}; name a folder of word lists")
    return list(ENGLISH)
