"""Word lists.

Fixed values: they decide results and are kept as plain text in natural order. They stand in for
lexicons and parsers that are not available, see the README.
"""

#: Stop words that content tokens leave out (the same list on every side of a comparison).
STOP_WORDS = (
    "the and for that with was are from this not you your have has had but they his her its our out all can will"
    " der die und den das ist von mit auf für nicht ein eine als auch sich dem des"
    " les des une est dans que qui pour pas sur avec par plus sont"
    " los las del que una por con para como más pero sus"
).split()

QUESTION_WORDS = "what why how when where who which whose whom is are do does did can could will would should have has am was were".split()
IMPERATIVE_WORDS = "stop watch look try make learn see discover find listen check wait imagine start get go don't never".split()
PROBLEM_WORDS = "problem mistake wrong error fail worst struggle hate".split()
PROMISE_WORDS = "secret trick hack guarantee easy fast best free".split()
POLEMIC_WORDS = "nobody everyone truth lie exposed banned scandal".split()

# These lists decide published fields and are taken whole, in their order.

INTENSIFIERS = (
    "never always incredible shocking worst best unbelievable insane absolutely literally extremely terrible amazing awful perfect horrible"
    " fantastic ridiculous impossible urgent critical crazy mindblowing viral exposed banned secret leaked"
).split()

#: Calls to action of a description, and of the sentences of a script.
CTA_VERBS = (
    "subscribe|follow|like|comment|share|click|check out|visit|buy|get|download|sign up|join|register|watch|see|learn more|find out|tap|swipe|link in bio"
    "|turn on|hit the bell|notify|save|bookmark|tag|dm|contact|order|shop"
).split("|")
CALL_VERBS = (
    "subscribe|follow|like|comment|share|click|check out|visit|buy|get|download|sign up|join|watch|learn more|tap|swipe|turn on|hit the bell|save|tag|dm|contact|order|shop"
).split("|")
#: Anywhere in a text, also within a word.
URGENCY_WORDS = "now|today|limited|only|don't miss|hurry|last chance|immediately|exclusive|free|instant".split("|")
PERSON_WORDS = "person man woman boy girl child kid baby face people human guy lady male female teen adult elder crowd group couple family".split()

CATEGORIES = {
    "click": "interaction",
    "view": "exposure",
    "purchase": "conversion",
    "signup": "conversion",
}

POSITIVE_WORDS = "good great best love happy nice amazing easy free win perfect beautiful fun enjoy".split()
NEGATIVE_WORDS = "bad worst hate sad wrong fail problem terrible ugly lose angry fear danger pain".split()
#: Emotions that count towards impact, by word.
EMOTIONS = {
    "fear": "fear danger scared horror".split(),
    "anger": "angry hate rage fight".split(),
    "surprise": "shocking sudden unbelievable wow".split(),
    "anticipation": "soon next waiting ready".split(),
    "disgust": "gross ugly dirty nasty".split(),
}
#: Classes of words in a vocabulary report; other words are thematic.
ACTION_WORDS = "make get go do take use try watch play build cut run".split()
EMOTIONAL_WORDS = POSITIVE_WORDS + NEGATIVE_WORDS
#: Categories of emoji by a part of their name, looked up in this order.
EMOJI_CATEGORIES = {"face": "rosto", "heart": "coracao", "hand": "mao", "fire": "simbolo", "star": "simbolo"}
#: Names of common emoji.
EMOJI_NAMES = {
    "😂": "face with tears of joy",
    "😍": "smiling face with heart-eyes",
    "😱": "face screaming in fear",
    "❤": "red heart",
    "👍": "thumbs up hand",
    "👏": "clapping hands",
    "🔥": "fire",
    "⭐": "star",
    "🎉": "party popper",
}
#: The commonest short words of a language; a text is taken for the language whose words it holds most.
LANGUAGE_WORDS = {
    "de": "der die und das ist von mit nicht ein eine den zu".split(),
    "en": "the and of to in is that are for it was with".split(),
    "es": "el la de que en y los del las por con una".split(),
    "fr": "le la de et les des est en que dans un une".split(),
}
