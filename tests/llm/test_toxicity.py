import random

from structlens.llm import automata
from structlens.llm import toxicity as t
from structlens.llm.toxicity_lexicon import CLASSES, PATTERNS


def _sample(text: str, rng: random.Random) -> list[str]:
    """Random words along a path of a pattern."""
    out: list[str] = []
    for labels, optional, again in t.MACHINE._elements(text.removeprefix("^")):
        for _ in range(rng.randint(0 if optional else 1, 2 if again else 1)):
            name = rng.choice(labels)[0]
            if name == "_":
                out.append("qqq")
            elif name in CLASSES:
                out += rng.choice(CLASSES[name][1].split()).split(":")[0].split("-")
            elif name != "END":
                out.append(name)
    return out


def test_every_way_to_match_a_pattern_holds_a_trigger():
    rng = random.Random(7)
    for number, (_, text) in enumerate(PATTERNS):
        matched = 0
        for _ in range(300):
            words = _sample(text, rng)
            if number in t.MACHINE.run(t.LEXICON.read(words)):
                matched += 1
                assert not t.TRIGGERS.isdisjoint(words), (text, words)
        assert matched > 100, text


def test_machines_weigh_the_best_path_of_a_composition():
    lexicon = automata.Lexicon({"BAD": (0.5, "poor worse:0.9 very-poor:0.8"), "X": (0.0, "x")})
    machine = automata.Machine([automata.Pattern(("a",), "BAD+ X:0.25"), automata.Pattern(("b",), "^X ~2 BAD END:1.0"), automata.Pattern(("c",), "X? y BAD|z:0.1")])
    run = lambda text: machine.run(lexicon.read(text.split()))
    assert run("poor x") == {0: 0.75} and run("q poor , worse x") == {0: 1.65}
    assert run("very poor x") == {0: 1.05}
    assert run("x q q poor") == {1: 1.5} and run("q x poor") == {} and run("q , x poor , q") == {1: 1.5}
    assert run("x q q q poor") == {} and run("y z")[2] == 0.1 and run("x y worse")[2] == 0.9
    assert run("") == {} and machine.run([]) == {}


def flagged(text: str) -> bool:
    return max(t.score_text(text)[:4]) >= t.THRESHOLD


def test_abusive_passages_in_any_spelling_count():
    for text in (
        "Learn to read, bitch.",
        "You absolute W0RTHLE5S idiooot!",
        "hey s c u m b a g, did your br​ain fall out?",
        "@abc_12 you are a useless tw*t and everyone here knows it.",
        "> quoted: Кill yourself, loser.",
        "Alle Ausländer raus aus dem Verein, dreckiges Gesindel.",
        "Va te faire foutre, pauvre con.",
        "Los inmigrantes apestan y no pintan nada en el puerto.",
        "Las mujeres son demasiado est&uacute;pidas para este juego.",
        "I want to lick your hot wet dick all night.",
        "I will find out where you live.",
        "tu es un ABRUTI et ta mÃ¨re le sait",
        "You id​io​t!",
    ):
        assert flagged(text), text


def test_blunt_words_about_games_own_play_teasing_and_moderation_do_not():
    for text in (
        None,
        "",
        "   ",
        "I hate the iconography. It is awful, ugly and a waste of cardboard.",
        "Dumb luck decided the last scoring, I rolled like an idiot all night.",
        "Kill the third bandit, then choke the supply line at the granary.",
        "@abc_12 you cheeky bastard, brilliant move with the black barrel, congratulations.",
        "The moderators removed several insulting posts, please stay on topic.",
        "The goblin faction calls everyone idiot, moron and worm on its cards.",
        "Women and men of the village are separate meeple shapes in this printing.",
        "Der Idiotentest im Partyspiel war lustig, wir haben alle versagt.",
        "Quel coup idiot de ma part, j'ai tout perdu.",
        "Go to hell is the name of the third scenario.",
        "I will crush you next time, bring your best cards and a cake.",
        "The rooster tile, or cock in the old printing, may draft at setup.",
    ):
        assert not flagged(text), text


def test_very_long_text_is_read_to_its_end():
    assert flagged("A quiet line about cards.\n" * 20_000 + "You bastard!")
    assert not flagged("x" * 300_000)


def test_folding_undoes_markup_escapes_and_marks():
    assert [w for c in t.fold("<p>T&ecirc;te &amp; c0ol</p>").split() for w in t.unfold(c)] == ["tete", "cool"]
    assert t.fold("а" * 3) == "aaa"
    tag = "<a " + " ".join(f'data-{i}="you idiot {i}"' for i in range(40)) + ">"
    assert len(tag) > 600 and not flagged(f"A quiet {tag}line</a>.") and flagged(f"A {tag}quiet</a> line, you idiot.")


def test_scores_are_graded_and_depend_on_targets_and_scopes():
    top = lambda x: max(t.score_text(x)[:4])
    assert 0 < top("that was an idiot move by an idiot") < 1 or top("an idiot would do it") < 1
    assert 1 <= top("You idiot!") < top("You stupid idiot!") < top("You stupid worthless idiot!")
    assert top("You are not an idiot.") < 1 <= top("You are such an idiot.")
    assert top("I was such an idiot in round two.") < 1 and top("Posts that call others stupid idiots get removed by the moderators.") < 1
    assert top("Break the seal, then crush the guard.") < 1 <= top("I will break your jaw.")


def test_wordings_not_taken_from_any_text():
    for text in (
        "You pathetic little coward.", "Somebody should smash their teeth in, and yours, you clown.", "Refugees are nothing but vermin.", "We never serve gypsies.", "Du bist ein elender Versager.",
        "Tes parents ont honte, espèce de crétin.", "Eres una payasa.", "I hope they rot.", "Go die in a ditch.", "All foreigners are parasites.", "Nice tits, wanna suck my dick?",
    ):
        assert flagged(text), text
    for text in (
        "The pirate captain may kill one guard.", "No insults, no threats, please.", "Foreigner cards are shuffled into the deck.", "He hit rock bottom and lost the naked eye bonus.",
        "Roll the die; on a six the rat dies.", "Please do not call anyone an idiot here.", "The women and the men of the club meet on Friday.", "My ass was numb after six hours.",
    ):
        assert not flagged(text), text
