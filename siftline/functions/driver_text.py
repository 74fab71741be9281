"""Small texts that are read on the driver: RTF, JSON with comments, prompts. None of them is per row of a table."""

from __future__ import annotations

import re

# RTF destinations whose text is not content.
RTF_SKIPPED = ("fonttbl", "colortbl", "datastore", "stylesheet", "info", "pict", "object", "header", "footer", "footnote")
_RTF = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|(.)", re.DOTALL)
_RTF_CHARS = {"par": "\n", "line": "\n", "tab": "\t"}


def rtf_to_text(source: str) -> str:
    """Plain text of an RTF document: a token stream over a stack of (skipped, characters to skip after an escape)."""
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    skipped, width, pending = False, 1, 0
    for word, number, code, symbol, brace, char in _RTF.findall(source):
        if brace == "{":
            stack.append((skipped, width))
        elif brace == "}":
            skipped, width = stack.pop() if stack else (False, 1)
        elif symbol == "*" or word in RTF_SKIPPED:
            skipped = True
        elif skipped:
            continue
        elif word == "uc":
            width = int(number or 1)
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            pending = width
            continue
        elif word in _RTF_CHARS:
            out.append(_RTF_CHARS[word])
        else:
            text = bytes([int(code, 16)]).decode("latin-1") if code else {"~": " ", "\n": "\n", "\r": "\n", "-": "", "_": ""}.get(symbol, symbol) if symbol else char
            if text and pending:
                pending -= 1
            else:
                out.append(text)
            continue
        pending = 0
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def text_of(source: str) -> str:
    return rtf_to_text(source) if source.lstrip().startswith("{\\rtf") else source.strip()


_JSONC = re.compile(r'"(?:\\.|[^"\\])*"|//[^\r\n]*|/\*.*?(?:\*/|\Z)|,(?=\s*[}\]])', re.DOTALL)


def strip_comments(text: str) -> str:
    """Without // and /* */ comments; strings are left alone, an unterminated block swallows the rest."""
    return _JSONC.sub(lambda m: "" if m[0].startswith(("//", "/*")) else m[0], text)


def strip_trailing_commas(text: str) -> str:
    """Without commas that only white space parts from } or ]; strings are left alone."""
    return _JSONC.sub(lambda m: "" if m[0] == "," else m[0], text)


_RULES = 'Return JSON only with:\n- hit: boolean\n- reason: one sentence that explains the decision\n\nCandidate profile:\n{profile}\n\nJob ad:\n{ad}'


def match_prompt(ad: str, profile: str) -> str:
    return "You classify job ads strictly. Decide if this ad is an exceptional match for the profile; prefer false unless several distinctive strengths meet.\n\n" + _RULES.format(profile=profile, ad=ad)


def confirmation_prompt(ad: str, profile: str) -> str:
    return "This is a second, independent review of one ad that passed triage. Set hit only if the ad combines several distinctive parts of the profile; prefer false for ordinary matches.\n\n" + _RULES.format(profile=profile, ad=ad)


def triage_prompt(ads_json: str, profile: str) -> str:
    return (
        "Pick the ads that might be exceptional matches after a stricter review, and keep the list small. An ad's requirements are its requirements section where one was found, else its description.\n\n"
        "Return JSON only with a candidates array; each has\n- candidate_id: exactly one candidate_id of the ads\n- reason: one sentence\n\n"
        f"Candidate profile:\n{profile}\n\nJob ads JSON:\n{ads_json}"
    )


def title_vowel_prompt(title: str | None) -> str:
    return f"Return JSON only. Set hit=true if the first letter of the job title is A, E, I, O or U, else hit=false. Give a short reason.\n\nJob title: {title if isinstance(title, str) else ''}"
