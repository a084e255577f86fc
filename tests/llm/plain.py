"""Slow versions of corpus operators, one text or one pair at a time, to hold the operators against."""

import hashlib

import regex

from tidemark.llm import surrogates as S


def components(docs, size, percent):
    """docs: (id, text); id -> least id that links reach, by comparing all pairs."""

    def words(t):
        return (t or "").encode().lower().split()

    def shingles(w):
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = {d: shingles(words(t)) for d, t in docs}
    comp = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[a] & sets[b]]
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return comp


class Surrogates:
    """All texts at once, entity by entity."""

    def __init__(self, key, texts):
        self.key, self.nonces = key, {}
        found = {p[1:]: p[0] for t in sorted({t for t in texts if t}) for title, parts in self.mentions(t) for p in sorted(parts, reverse=True) if p[1] not in ("initial", "number")}
        group = lambda kind: "name" if kind.startswith("given") or kind == "family" else kind
        least = {}
        for t in texts:
            for _, parts in self.mentions(t) if t else ():
                for m, *e in parts:
                    least[tuple(e)] = min(m, least.get(tuple(e), m))
        entities = {e: least[e] for e in found}
        real = {(group(k), n) for k, n in entities}
        draw = 0
        while True:
            owners = {}
            for (k, n), m in entities.items():
                v = (group(k), self.normal(k, self.drawn(m, k, n)))
                owners.setdefault(v, []).append((k, n))
            lost = [e for v, own in owners.items() for e in own if v in real or "|".join(e) != min(map("|".join, own))]
            if not lost:
                break
            draw += 1
            self.nonces |= dict.fromkeys(lost, draw)

    @staticmethod
    def normal(kind, m):
        if kind in ("phone", "card", "ssn"):
            return regex.sub("[^0-9]", "", m)
        return m.replace(" ", "").upper() if kind == "iban" else m.lower()

    @staticmethod
    def luhn(digits):
        return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))

    def kind(self, m, card):
        digits = regex.sub("[^0-9]", "", m)
        tests = (
            (card, "card" if card and self.luhn(digits) % 10 == 0 else "number"),
            ("@" in m, "email"),
            (regex.search(r"^([0-9A-Fa-f]{1,4}:){7}|^[0-9A-Fa-f:]*::[0-9A-Fa-f:]*$", m), "ipv6"),
            (regex.search(r"^([0-9A-Fa-f]{2}:){5}", m), "mac"),
            (regex.fullmatch(r"([0-9]{1,3}\.){3}[0-9]{1,3}", m), "ipv4"),
            (regex.match(rf"{S._TITLE}(?:{S._NAME}|\p{{Lu}}\. )", m), "name"),
            (regex.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m), "ssn"),
            (regex.fullmatch("[0-9A-Fa-f]{32,128}", m), "secret"),
            (regex.fullmatch("[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){3,7}( ?[A-Z0-9]{1,3})?", m), "iban"),
            (m[0] in "+(" or regex.fullmatch("[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}", m), "phone"),
        )
        return next((k for hit, k in tests if hit), "secret")

    def mentions(self, text):
        out = []
        for x in regex.finditer(S.ANY, text):
            kind = self.kind(x[0], x[1] or "")
            if kind != "name":
                out.append(("", [(x[0], kind, self.normal(kind, x[0]))]))
                continue
            title = regex.match(S._TITLE, x[0])[0]
            has = lambda ts: any(w.rstrip(".") in ts for w in title.split())
            given = "given_f" if has(S.FEMALE_TITLES) else "given_m" if has(S.MALE_TITLES) else "given_n"
            words = x[0][len(title) :].split(" ")
            out.append((title, [(w, "initial" if regex.fullmatch(r"\p{Lu}\.", w) else given if i < len(words) - 1 else "family", w.lower()) for i, w in enumerate(words)]))
        return out

    def drawn(self, m, kind, normal):
        nonce = self.nonces.get((kind, normal), 0)
        seed = "|".join((self.key, kind, normal, str(nonce)))
        stream = "".join(hashlib.sha256(f"{seed}|{i}".encode()).hexdigest() for i in range(4))
        byte = lambda i: int(stream[i % 128 * 2 : i % 128 * 2 + 2], 16)

        def shaped(text, keep=0, is_hex=False, is_upper=False):
            out = ""
            for i, c in enumerate(text):
                digit = regex.match("[0-9]", c)
                v = byte(i if is_hex else len(regex.sub("[^0-9]", "", text[: i + 1])) - 1 if digit else i + 37)
                greek = regex.match(r"\p{Greek}", c)
                sets = (
                    (i < keep, c),
                    (is_hex and regex.match("[0-9A-Fa-f]", c), "0123456789ABCDEF" if is_upper else "0123456789abcdef"),
                    (digit, "0123456789"),
                    (regex.match("[а-яё]", c), "абвгдежзиклмнопрстуфх"),
                    (regex.match("[А-ЯЁ]", c), "АБВГДЕЖЗИКЛМНОПРСТУФХ"),
                    (greek and c.islower(), "αβγδεζηθικλμνοπρστυφχψω"),
                    (greek and c.isupper(), "ΑΒΓΔΕΖΗΘΙΚΛΜΝΟΠΡΣΤΥΦΧΨΩ"),
                    (regex.match(r"\p{Ll}", c), "abcdefghijklmnopqrstuvwxyz"),
                    (regex.match(r"\p{Lu}", c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                    (regex.match(r"\p{Han}", c), S.HAN),
                    (regex.match(r"\p{L}", c), "abcdefghijklmnopqrstuvwxyz"),
                    (True, c),
                )
                own = next(s for hit, s in sets if hit)
                out += own[v % len(own)]
            return out

        is_hex = bool(regex.search("^[0-9A-Fa-f]{32,}$|^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$", m))
        if kind == "number":
            return m
        if kind == "email":
            local = shaped(m.split("@")[0])
            more = stream[199 : 199 + max(8 - len(local), 0)].translate(str.maketrans("0123456789", "ghijklmnop"))
            host, end = shaped(regex.search(r"@([^.]+)\.", m)[1]), regex.search(r"(?i)\.(org|net)$", m)
            return f"{local}{more}@{host}.example.{end[1].lower() if end else 'com'}"
        if kind == "ipv4":
            return ".".join(map(str, (byte(0) % 223 + 1, byte(1), byte(2), byte(3))))
        if kind == "ipv6" and "::" in m:
            return ":".join(g and stream[4 * i : 4 * i + 4] for i, g in enumerate(m.split(":")))
        if kind == "secret" and (len(regex.sub(r"[^\p{L}0-9]", "", m)) < 8 or nonce >= S.LONGER_FROM):
            return stream[: max(16, min(256, len(m)))]
        if kind.startswith("given") or kind in ("family", "initial"):
            script = "cyrillic" if regex.search(r"\p{Cyrillic}", m) else "greek" if regex.search(r"\p{Greek}", m) else "latin"
            syllable = lambda i, own: own[byte(i) % len(own)]
            at = [syllable(i, S.SYLLABLES[script]) for i in range(4)]
            if kind.startswith("given"):
                at[3] = syllable(3, S.GIVEN_ENDS[kind[-1], script])
            front = at[0] + "".join(syllable(i + 8, S.SYLLABLES[script]) for i in range(1, nonce - S.LONGER_FROM + 1)) + at[1]
            made = f"{front.capitalize()}-{(at[2] + at[3]).capitalize()}" if "-" in m else (front + at[2] + at[3]).capitalize()
            made = made.upper() if m == m.upper() and len(m) > 1 else made
            return made[0].upper() + "." if kind == "initial" else made
        plus = regex.match(r"\+[0-9]{1,3}(?=[ .(-])", m) or regex.match(r"\+[0-9]", m)
        sign = regex.match("AKIA|ASIA|gh[pousr]_|sk-", m)
        keep = {"phone": len(plus[0]) if plus else 0, "iban": 2, "secret": len(sign[0]) if sign else 0}.get(kind, 0)
        made = shaped(m, keep, is_hex, m == m.upper())
        if kind == "card":
            body = made[:-1]
            return body + str(-self.luhn(regex.sub("[^0-9]", "", body) + "0") % 10)
        if kind == "iban":
            compact = made.replace(" ", "").upper()
            number = int("".join(str(int(c, 36)) for c in compact[4:] + compact[:2] + "00"))
            return f"{made[:2]}{98 - number % 97:02}{made[4:]}"
        return made

    def replace(self, text):
        if not text:
            return text
        found = self.mentions(text)
        done = [(title, parts, [self.drawn(*p) for p in parts]) for title, parts in found]
        words = dict.fromkeys((p[0], d) for title, parts, drawn in done if title for p, d in zip(parts, drawn) if p[1] != "initial")
        gaps, at = [], 0
        for x in regex.finditer(S.ANY, text):
            gaps.append(text[at : x.start()])
            at = x.end()
        gaps.append(text[at:])
        for w, d in words:
            gaps = [regex.sub(rf"(?<![\p{{L}}\p{{M}}'’-]){w}(?!['’-]?[\p{{L}}\p{{M}}])", d, g) for g in gaps]
        return "".join(g + (x[0] + " ".join(x[2]) if x else "") for g, x in zip(gaps, [*done, None]))
