"""Messages to text, and to what their sender wrote."""

import base64

import pytest

from tidemill.llm import mail


def own(text):
    return mail.own_text(mail.body_text(mail.parts(text)))


def nest(depth):
    head, tail = "", ""
    for k in range(depth):
        head += f'Content-Type: multipart/mixed; boundary="b{k}"\n\n--b{k}\n'
        tail = f"\n--b{k}--\n" + tail
    return head + "Content-Type: text/plain\n\nthe innermost text" + tail


@pytest.mark.parametrize("depth", [1, 5, 25, 300])
def test_nesting_of_any_depth(depth):
    assert [p.text.strip() for p in mail.parts(nest(depth))] == ["the innermost text"]


def test_markup_is_told_wherever_it_begins():
    text = "Content-Type: text/plain\n\n" + " " * 500 + "\n<html><p>one two</p></html>"
    assert [p.kind for p in mail.parts(text)] == ["html"]
    assert [p.kind for p in mail.parts("Content-Type: text/plain\n\nabout <html> tags")] == ["plain"]


def test_parts_in_order_and_of_which_alternative():
    text = 'Content-Type: multipart/mixed; boundary=o\n\n--o\nContent-Type: multipart/alternative; boundary=i\n\n--i\n\nplain\n--i\nContent-Type: text/html\n\n<b>rich</b>\n--i--\n--o\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\niVBORw0KGgo=\n--o\nContent-Type: text/plain\nContent-Disposition: attachment\n\nattached\n'
    assert [(p.kind, p.text.strip(), p.attached, p.alternative) for p in mail.parts(text)] == [("plain", "plain", False, 1), ("html", "<b>rich</b>", False, 1), ("plain", "attached", True, 0)]
    assert own(text).strip() == "plain"


def test_odd_inputs_never_raise():
    for text in (None, "", "\n\n", "no headers at all", "Subject: x", "From a@b\n", "Content-Type: multipart/mixed; boundary=x\n\nno boundary here", "Content-Transfer-Encoding: base64\n\n@@@", "Content-Type: text/plain; charset=nonsense\nContent-Transfer-Encoding: base64\n\n/////w==", "\ud800 broken"):
        mail.parts(text)
        own(text)


def test_truncated_base64():
    whole = "the quick brown fox jumps over the lazy dog " * 4
    cut = base64.b64encode(whole.encode()).decode()[:101]
    assert mail.parts("Content-Transfer-Encoding: base64\n\n" + cut)[0].text.startswith("the quick brown fox")


def test_own_words_only():
    text = "Subject: x\n\nHi Anna,\n\nI will come on Monday.\nSee you there.\n\nBest regards,\nTom\n+1 555 0100\n\nOn 3 May 2021, Anna wrote:\n> when do you come?\n> let me know\n"
    assert own(text) == "I will come on Monday.\nSee you there."


def test_reply_below_a_quote():
    assert own("Subject: x\n\nOn 3 May 2021, Anna <a@b.c> wrote:\n> old words\n\nmy own answer is here\n") == "my own answer is here"


def test_small_print_is_left_out_and_plain_talk_is_not():
    note = "This message is confidential and intended only for the person named above. If you are not the intended recipient please delete it."
    assert own("Subject: x\n\nthe numbers are ready\n\n" + note) == "the numbers are ready"
    talk = "please keep the price list confidential until we have spoken to the other team about it because they have not yet agreed to the change and nobody there should hear of it from a list that was sent round by somebody else before we had our say"
    assert own("Subject: x\n\n" + talk) == talk


def test_words():
    assert mail.words("It's Über-gut, co­op 3x_y") == ["it", "s", "über", "gut", "coop", "3x", "y"]
