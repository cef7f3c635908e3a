"""Special functions as native expressions, and erfc for result rows."""

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def zeta_sql(s: str, q: str, terms: int = 20) -> str:
    """Hurwitz zeta(s, q), s > 1, as SQL text: explicit terms, then Euler-Maclaurin.  Both Spark and DuckDB read it."""
    far = f"({q} + {terms})"
    head = " + ".join(f"pow({q} + {k}, -({s}))" for k in range(terms))
    rising = [f"({s} + {k})" for k in range(5)]
    tail = [
        f"pow({far}, 1 - ({s})) / ({s} - 1)",
        f"0.5 * pow({far}, -({s}))",
        f"({s}) * pow({far}, -({s}) - 1) / 12",
        f"-({' * '.join(rising[:3])}) * pow({far}, -({s}) - 3) / 720",
        f"({' * '.join(rising)}) * pow({far}, -({s}) - 5) / 30240",
    ]
    return f"({head} + {' + '.join(tail)})"


def scaled_zeta_sql(s: str, q: str, unit: str, terms: int = 20) -> str:
    """zeta(s, q) times unit^s, which doesn't vanish where s is large and unit near q."""
    far = f"({q} + {terms})"
    head = " + ".join(f"pow(({q} + {k}) / {unit}, -({s}))" for k in range(terms))
    rising = [f"({s} + {k})" for k in range(5)]
    tail = f"{far} / ({s} - 1) + 0.5 + {s} / (12 * {far}) - {' * '.join(rising[:3])} / (720 * pow({far}, 3)) + {' * '.join(rising)} / (30240 * pow({far}, 5))"
    return f"({head} + pow({far} / {unit}, -({s})) * ({tail}))"


def zeta_slope_sql(s: str, q: str, terms: int = 20) -> str:
    """The derivative of zeta(s, q) in s, term by term of zeta_sql."""
    far = f"({q} + {terms})"
    head = " + ".join(f"ln({q} + {k}) * pow({q} + {k}, -({s}))" for k in range(terms))
    log = f"ln({far})"
    third, fifth = f"({s} * ({s} + 1) * ({s} + 2))", f"({s} * ({s} + 1) * ({s} + 2) * ({s} + 3) * ({s} + 4))"
    third_slope, fifth_slope = f"(3 * {s} * {s} + 6 * {s} + 2)", f"(5 * pow({s}, 4) + 40 * pow({s}, 3) + 105 * {s} * {s} + 100 * {s} + 24)"
    tail = [
        f"-pow({far}, 1 - {s}) * ({log} / ({s} - 1) + 1 / (({s} - 1) * ({s} - 1)))",
        f"-0.5 * {log} * pow({far}, -{s})",
        f"(1 - {s} * {log}) * pow({far}, -{s} - 1) / 12",
        f"-({third_slope} - {third} * {log}) * pow({far}, -{s} - 3) / 720",
        f"({fifth_slope} - {fifth} * {log}) * pow({far}, -{s} - 5) / 30240",
    ]
    return f"(-({head}) + {' + '.join(tail)})"


def zeta_and_slopes(s: Column, q: Column, terms: int = 20) -> Column:
    """A struct z, z1, z2: q^s zeta(s, q) (which doesn't vanish for large s) and its first two derivatives in s, as one native
    expression: explicit terms by an aggregate over a sequence, the rest by Euler-Maclaurin (polynomials in s times powers of
    q + terms)."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("z", "z1", "z2")])

    def more(sums: Column, k: Column) -> Column:
        log = F.ln((q + k) / q)
        one = F.exp(-s * log)
        return F.struct((sums["z"] + one).alias("z"), (sums["z1"] - log * one).alias("z1"), (sums["z2"] + log * log * one).alias("z2"))

    head = F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), zero, more)
    far = q + terms
    log = F.ln(far / q)
    # the integral, half the first term, and the Bernoulli terms: (polynomial, its slopes, power of far, factor)
    whole = far * F.exp(-s * log) / (s - 1)
    parts = [(whole, -whole * (log + 1 / (s - 1)), whole * (log * log + 2 * log / (s - 1) + 2 / ((s - 1) * (s - 1))))]
    p3, p3a, p3b = s * (s + 1) * (s + 2), 3 * s * s + 6 * s + 2, 6 * s + 6
    p5 = p3 * (s + 3) * (s + 4)
    p5a, p5b = 5 * s * s * s * s + 40 * s * s * s + 105 * s * s + 100 * s + 24, 20 * s * s * s + 120 * s * s + 210 * s + 100
    for p, pa, pb, power, factor in ((F.lit(1.0), F.lit(0.0), F.lit(0.0), 0.0, 0.5), (s, F.lit(1.0), F.lit(0.0), 1.0, 1 / 12), (p3, p3a, p3b, 3.0, -1 / 720), (p5, p5a, p5b, 5.0, 1 / 30240)):
        one = factor * F.exp(-s * log) / F.pow(far, F.lit(power))
        parts.append((p * one, (pa - p * log) * one, (pb - 2 * pa * log + p * log * log) * one))
    rest = [sum((x[k] for x in parts[1:]), parts[0][k]) for k in range(3)]
    return F.struct((head["z"] + rest[0]).alias("z"), (head["z1"] + rest[1]).alias("z1"), (head["z2"] + rest[2]).alias("z2"))


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or math.isnan(v) else math.erfc(v))
