"""LaTeX formulas as Office Math: a tokenizer and a recursive reader that builds elements."""

from __future__ import annotations

import re
from xml.sax.saxutils import escape

# fixed values: characters of commands, n-ary operators, accents and named functions
SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ϵ", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "vartheta": "ϑ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "ϕ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "times": "×", "cdot": "⋅", "div": "÷", "pm": "±", "mp": "∓", "ast": "∗", "star": "⋆", "circ": "∘", "bullet": "∙", "oplus": "⊕", "otimes": "⊗",
    "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "ne": "≠", "approx": "≈", "equiv": "≡", "sim": "∼", "simeq": "≃", "cong": "≅", "propto": "∝", "ll": "≪", "gg": "≫",
    "in": "∈", "notin": "∉", "ni": "∋", "subset": "⊂", "supset": "⊃", "subseteq": "⊆", "supseteq": "⊇", "cup": "∪", "cap": "∩", "emptyset": "∅", "forall": "∀", "exists": "∃", "neg": "¬", "wedge": "∧", "vee": "∨",
    "to": "→", "rightarrow": "→", "leftarrow": "←", "leftrightarrow": "↔", "Rightarrow": "⇒", "Leftarrow": "⇐", "Leftrightarrow": "⇔", "mapsto": "↦", "uparrow": "↑", "downarrow": "↓",
    "infty": "∞", "partial": "∂", "nabla": "∇", "hbar": "ℏ", "ell": "ℓ", "Re": "ℜ", "Im": "ℑ", "angle": "∠", "perp": "⊥", "parallel": "∥", "prime": "′", "dots": "…", "ldots": "…", "cdots": "⋯", "vdots": "⋮", "ddots": "⋱",
    "langle": "⟨", "rangle": "⟩", "lfloor": "⌊", "rfloor": "⌋", "lceil": "⌈", "rceil": "⌉", "mid": "∣", "quad": " ", "qquad": "  ", ",": " ", ";": " ", ":": " ", "!": "", " ": " ", "{": "{", "}": "}", "%": "%", "&": "&", "#": "#", "_": "_", "$": "$", "|": "‖",
}
NARY = {"sum": "∑", "prod": "∏", "int": "∫", "iint": "∬", "iiint": "∭", "oint": "∮", "bigcup": "⋃", "bigcap": "⋂"}
ACCENTS = {"hat": "̂", "widehat": "̂", "tilde": "̃", "widetilde": "̃", "bar": "̅", "overline": "̅", "vec": "⃗", "dot": "̇", "ddot": "̈"}
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "log", "ln", "exp", "lim", "max", "min", "sup", "inf", "det", "dim", "ker", "gcd", "arg", "deg", "Pr")
_TOKENS = re.compile(r"\\([A-Za-z]+\*?|.)|([{}^_&])|(\s+)|(.)", re.S)


def _run(text: str, plain: bool = False) -> str:
    style = '<m:rPr><m:sty m:val="p"/></m:rPr>' if plain else ""
    return f'<m:r>{style}<m:t xml:space="preserve">{escape(text)}</m:t></m:r>' if text else ""


def _e(body: str, name: str = "e") -> str:
    return f"<m:{name}>{body}</m:{name}>"


class _Reader:
    def __init__(self, source: str):
        self.tokens = [("cmd", m[1]) if m[1] is not None else ("mark", m[2]) if m[2] else ("space", " ") if m[3] else ("char", m[4]) for m in _TOKENS.finditer(source)]
        self.at = 0

    def peek(self):
        while self.at < len(self.tokens) and self.tokens[self.at][0] == "space":
            self.at += 1
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def next(self):
        t = self.peek()
        self.at += 1
        return t

    def group(self) -> str:
        """A braced group or the next atom."""
        if self.peek() == ("mark", "{"):
            self.next()
            return self.until(lambda t: t == ("mark", "}"))
        return self.atom()

    def plain(self) -> str:
        """A braced group's characters as they are."""
        if self.peek() != ("mark", "{"):
            return self.next()[1] or ""
        self.next()
        depth, out = 1, []
        while self.at < len(self.tokens) and depth:
            kind, text = self.tokens[self.at]
            self.at += 1
            depth += (text == "{") - (text == "}") if kind == "mark" else 0
            if depth:
                out.append(SYMBOLS.get(text, text) if kind == "cmd" else text)
        return "".join(out)

    def until(self, end) -> str:
        out = []
        while True:
            t = self.peek()
            if t[0] is None:
                return "".join(out)
            if end(t):
                self.next()
                return "".join(out)
            out.append(self.scripted())

    def scripted(self) -> str:
        kind, name = self.peek()
        nary = NARY.get(name) if kind == "cmd" else None
        base = "" if nary else self.atom()
        if nary:
            self.next()
            if self.peek() in (("cmd", "limits"), ("cmd", "nolimits")):
                self.next()
        low = high = None
        while self.peek() in (("mark", "^"), ("mark", "_"), ("char", "'")):
            mark = self.next()[1]
            if mark == "'":
                high = (high or "") + _run("′")
            elif mark == "^":
                high = (high or "") + self.group()
            else:
                low = (low or "") + self.group()
        if nary:
            hide = "".join(f'<m:{n}Hide m:val="1"/>' for n, v in (("sub", low), ("sup", high)) if v is None)
            return f'<m:nary><m:naryPr><m:chr m:val="{nary}"/>{hide}</m:naryPr>{_e(low or "", "sub")}{_e(high or "", "sup")}{_e(self.scripted() if self.peek()[0] and self.peek() != ("mark", "}") else "")}</m:nary>'
        if low is not None and high is not None:
            return f"<m:sSubSup>{_e(base)}{_e(low, 'sub')}{_e(high, 'sup')}</m:sSubSup>"
        if low is not None:
            return f"<m:sSub>{_e(base)}{_e(low, 'sub')}</m:sSub>"
        return f"<m:sSup>{_e(base)}{_e(high, 'sup')}</m:sSup>" if high is not None else base

    def atom(self) -> str:
        kind, text = self.next()
        if kind is None:
            return ""
        if kind == "mark":
            if text == "{":
                return self.until(lambda t: t == ("mark", "}"))
            return "" if text in "&}" else self.group()
        if kind == "char":
            return _run(text)
        if text in ("frac", "dfrac", "tfrac", "binom"):
            bar = '<m:fPr><m:type m:val="noBar"/></m:fPr>' if text == "binom" else ""
            return f"<m:f>{bar}{_e(self.group(), 'num')}{_e(self.group(), 'den')}</m:f>"
        if text == "sqrt":
            degree = ""
            if self.peek() == ("char", "["):
                self.next()
                degree = self.until(lambda t: t == ("char", "]"))
            return f"<m:rad>{'' if degree else '<m:radPr><m:degHide m:val=\"1\"/></m:radPr>'}{_e(degree, 'deg')}{_e(self.group())}</m:rad>"
        if text in ACCENTS:
            return f'<m:acc><m:accPr><m:chr m:val="{ACCENTS[text]}"/></m:accPr>{_e(self.group())}</m:acc>'
        if text in ("text", "mathrm", "operatorname", "mbox", "textrm"):
            return _run(self.plain(), plain=True)
        if text in ("mathbf", "mathit", "mathcal", "mathbb", "mathsf", "boldsymbol", "displaystyle", "textstyle"):
            return self.group() if text not in ("displaystyle", "textstyle") else ""
        if text == "left":
            opens = self.delimiter()
            body = self.until(lambda t: t == ("cmd", "right"))
            return f'<m:d><m:dPr><m:begChr m:val="{escape(opens)}"/><m:endChr m:val="{escape(self.delimiter())}"/></m:dPr>{_e(body)}</m:d>'
        if text == "begin":
            return self.matrix(self.plain())
        if text in FUNCTIONS:
            return _run(text, plain=True)
        return _run(SYMBOLS.get(text, text if len(text) == 1 else f"\\{text}"))

    def delimiter(self) -> str:
        kind, text = self.next()
        return "" if text in (".", None) else SYMBOLS.get(text, text) if kind == "cmd" else text

    def matrix(self, name: str) -> str:
        rows, cell = [[]], []
        while True:
            t = self.peek()
            if t[0] is None or t == ("cmd", "end"):
                break
            if t == ("mark", "&") or t == ("cmd", "\\"):
                self.next()
                rows[-1].append("".join(cell))
                cell = []
                if t[0] == "cmd":
                    rows.append([])
                continue
            cell.append(self.scripted())
        if self.peek()[0]:
            self.next()
            self.plain()
        if cell or not rows[-1] and len(rows) == 1:
            rows[-1].append("".join(cell))
        body = "<m:m>" + "".join(_e("".join(_e(c) for c in r), "mr") for r in rows if r) + "</m:m>"
        ends = {"pmatrix": "()", "bmatrix": "[]", "vmatrix": "||", "cases": "{ "}.get(name.rstrip("*"))
        return f'<m:d><m:dPr><m:begChr m:val="{ends[0]}"/><m:endChr m:val="{ends[1].strip()}"/></m:dPr>{_e(body)}</m:d>' if ends else body


def to_omml(latex: str) -> str:
    """An m:oMath element; commands that aren't known stay as text."""
    source = latex.strip().strip("$").strip()
    return f"<m:oMath>{_Reader(source).until(lambda t: False)}</m:oMath>"
