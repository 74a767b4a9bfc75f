"""The few places where Spark SQL and DuckDB SQL differ; checks are written once over them."""

from __future__ import annotations


class Spark:
    """Spark SQL (Java regular expressions)."""

    def lit(self, text: str) -> str:
        return "r'" + text.replace("(?i)", "(?iu)") + "'"

    def like(self, s: str, pattern: str) -> str:
        return f"regexp_like({s}, {self.lit(pattern)})"

    def extract(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({s}, {self.lit(pattern)}, {group})"

    def cut(self, s: str, pattern: str) -> str:
        """``s`` without the only match of an anchored pattern."""
        return f"regexp_replace({s}, {self.lit(pattern)}, '')"

    def replace_all(self, s: str, pattern: str, group: int, tail: str) -> str:
        """Every match by one of its groups and ``tail``."""
        return f"regexp_replace({s}, {self.lit(pattern)}, '${group}{tail}')"

    def digits(self, s: str) -> str:
        return f"regexp_replace({s}, '[^0-9]', '')"

    def count(self, s: str, pattern: str) -> str:
        return f"CAST(regexp_count({s}, {self.lit(pattern)}) AS BIGINT)"

    def bytes(self, s: str) -> str:
        return f"octet_length({s})"

    def luhn(self, s: str) -> str:
        return f"luhn_check({s})"

    def most(self, top: int, test: str) -> str:
        """The largest k in 0..top for which ``test`` (over k) holds."""
        return f"array_max(filter(sequence(0, {top}), k -> {test}))"

    def window(self, side: str, s: str, top: int) -> str:
        """The characters at one side of ``s`` within ``top`` bytes; a mark stands for one that the window cuts. Cut by bytes, which costs what the window is long."""
        inner = lambda i: f"substring(w_.raw, {i} + 1, 1) BETWEEN X'80' AND X'BF'"  # noqa: E731  a byte that goes on with a character
        steps = [str(top - k) if side == "left" else f"(w_.n - {top - k})" for k in range(4)]
        edge = "CASE " + " ".join(f"WHEN NOT {inner(i)} THEN {i}" for i in steps[:3]) + f" ELSE {steps[3]} END"
        if side == "left":
            cut = f"CAST(substring(w_.raw, 1, e_) AS STRING) || CASE WHEN e_ < {top} THEN '\u00a7' ELSE '' END"
        else:
            cut = f"CASE WHEN w_.n - e_ < {top} THEN '\u00a7' ELSE '' END || CAST(substring(w_.raw, e_ + 1, w_.n - e_) AS STRING)"
        bound = f"transform(array(named_struct('raw', encode({s}, 'UTF-8'), 'n', octet_length({s}))), w_ -> transform(array({edge}), e_ -> {cut})[0])[0]"
        return f"(CASE WHEN octet_length({s}) <= {top} THEN {s} ELSE {bound} END)"


class Duck(Spark):
    """DuckDB SQL (RE2)."""

    def lit(self, text: str) -> str:
        return "'" + text + "'"

    def like(self, s: str, pattern: str) -> str:
        return f"regexp_matches({s}, {self.lit(pattern)})"

    def replace_all(self, s: str, pattern: str, group: int, tail: str) -> str:
        return f"regexp_replace({s}, {self.lit(pattern)}, '\\{group}{tail}', 'g')"

    def digits(self, s: str) -> str:
        return f"regexp_replace({s}, '[^0-9]', '', 'g')"

    def count(self, s: str, pattern: str) -> str:
        return f"len(regexp_extract_all({s}, {self.lit(pattern)}))"

    def bytes(self, s: str) -> str:
        return f"strlen({s})"

    def luhn(self, s: str) -> str:
        digit = f"CAST(substr({s}, i, 1) AS INT)"
        return f"list_sum(list_transform(range(1, strlen({s}) + 1), lambda i: CASE WHEN (strlen({s}) - i) % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0"

    def most(self, top: int, test: str) -> str:
        return f"list_max(list_filter(range(0, {top} + 1), lambda k: {test}))"

    def window(self, side: str, s: str, top: int) -> str:
        inside = f"{side}({s}, {self.most(top, f'{self.bytes(f'{side}({s}, CAST(k AS INT))')} <= {top}')})"
        guard = f"CASE WHEN {self.bytes(s)} > {top} AND {self.bytes(inside)} < {top} THEN '\u00a7' ELSE '' END"
        return f"({guard} || {inside})" if side == "right" else f"({inside} || {guard})"


SPARK, DUCK = Spark(), Duck()
