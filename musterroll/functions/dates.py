"""Calendar text as native column expressions.

Dates stay text (``DD/MM/YYYY``).  A date is first laid out with two-digit
day and month and four-digit year, and then one regular expression decides
whether that day exists.  No parser exceptions are raised on bad input, which
is what makes this cheap on dirty columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from musterroll.functions import text as X

UK_SHAPE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"
UK_PADDED = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}\z"

# Day exists: any month up to 28, then 29/30, then 31, then leap days.
_LEAP = r"(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
EXISTS = (
    r"^(?!.*/0000)(?:(?:0[1-9]|1[0-9]|2[0-8])/(?:0[1-9]|1[0-2])/[0-9]{4}"
    r"|(?:29|30)/(?:0[13-9]|1[0-2])/[0-9]{4}"
    r"|31/(?:0[13578]|1[02])/[0-9]{4}"
    rf"|29/02/{_LEAP})\z"
)

_CLOCK = (
    r"[ T](?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?"
    r"(?: ?[AaPp][Mm]|Z)?\z"
)
_DAY_FIRST = r"^[0-9]{1,2}[/. -][0-9]{1,2}[/. -](?:[0-9]{4}|[0-9]{2})\z"
_YEAR_FIRST = r"^([0-9]{4})[/.-]([0-9]{1,2})[/.-]([0-9]{1,2})\z"
_COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})\z"
# Words and marks of an order-free date; the text is in lower case by then.
_MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_WORD = r"(?=[{}])(?<![a-z]){}(?![a-z])"  # first the letters that such words begin with, which rule out most places
_MONTH_WORD = _WORD.format("jfmasond", _MONTH) + r"\.?"
_WEEKDAY_WORD = _WORD.format("mtwfs", r"(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?") + r"\.?"
_FILLER = r"(?=[snrt])(?<=[0-9])(?:st|nd|rd|th)(?![a-z])|" + _WORD.format("oaug", "(?:of|at|on|and|ad|utc|gmt)")
_MINUTES = r":[0-5][0-9](?::[0-5][0-9](?:[.,][0-9]+)?)?"
_CLOCK_WORD = (
    r"(?:(?<=[0-9])t|(?<=[ ,])|^)"
    rf"(?:(?:1[0-2]|0?[1-9])(?:{_MINUTES})? ?[ap]\.?m\.?|(?:[01]?[0-9]|2[0-3]){_MINUTES})"
    r"(?: ?(?:z|utc|gmt|[+-][0-9]{2}:?[0-9]{2}))?(?![0-9a-z:])"
)
_MAYBE_CLOCK = r":|[ap]\.?m"  # every clock has one of these
_MARKS = r"[ .,;/'-]+"
_SEEN = {"clock": "\x02", "weekday": "\x03", "month": "\x04"}  # characters that stand for words that were found
_MONTH_ORDER = "janfebmaraprmayjunjulaugsepoctnovdec"

SERIAL_EPOCH = "1899-12-30"
SERIAL_RANGE = (-693593, 2958465)  # 01/01/0001 .. 31/12/9999

# Two-digit years fall into the hundred years that start here.
CENTURY_START = 1976


def exists(text: Column) -> Column:
    """Whether ``DD/MM/YYYY`` names a real day (there is no year 0000)."""
    return text.rlike(EXISTS)


def padded(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![0-9])([0-9])(?![0-9])", "0$1")


def swapped(text: Column) -> Column:
    """Exchange day and month of a padded date."""
    return F.regexp_replace(text, "^(..)/(..)/", "$2/$1/")


def _full_year(text: Column) -> Column:
    """Widen ``DD/MM/YY`` to four-digit years."""
    century, pivot = divmod(CENTURY_START, 100)
    late = F.right(text, F.lit(2)) >= f"{pivot:02d}"
    prefix = F.when(late, str(century)).otherwise(str(century + 1))
    return F.when(F.length(text) == 8, F.concat(F.left(text, F.lit(6)), prefix, F.right(text, F.lit(2)))).otherwise(text)


def _bare(text: Column) -> Column:
    """The text without a clock at its end."""
    return F.when(text.contains(":"), F.regexp_replace(text, _CLOCK, "")).otherwise(text)


def _slashed(bare: Column) -> Column:
    """The commonest shape, day, month and year as numbers, with two digits and slashes; else null."""
    return F.when(bare.rlike(_DAY_FIRST), F.translate(padded(bare), ".- ", "///"))


def _tokens(bare: Column, slashed: Column) -> Column:
    """The words of a text of no usual shape: marked month names, numbers, and whatever is no part of a date.

    One clock and one weekday may stand anywhere; they, ordinal endings and
    filling words are dropped.
    """
    clock, weekday, month = (f" {mark}" for mark in _SEEN.values())

    def once(t: Column) -> Column:
        """Without the one clock and the one weekday, and the blanks that they leave."""
        out = t
        for mark in (clock, weekday):
            out = F.regexp_replace(out, f"^([^{mark[1]}]*){mark}([^{mark[1]}]*)$", "$1$2")  # a second one stays, and is no part of a date
        return F.when(t.contains(clock[1]) | t.contains(weekday[1]), F.regexp_replace(out, " +", " ")).otherwise(t)

    t = X.let(F.lower(bare), lambda t: F.when(t.rlike(_MAYBE_CLOCK), F.regexp_replace(t, _CLOCK_WORD, clock + " ")).otherwise(t))
    t = F.regexp_replace(F.regexp_replace(t, _WEEKDAY_WORD, weekday + " "), _MONTH_WORD, month + "$1 ")
    t = X.let(F.regexp_replace(F.regexp_replace(t, _FILLER, " "), _MARKS, " "), once)
    usual = slashed.isNotNull() | bare.rlike(_YEAR_FIRST) | bare.rlike(_COMPACT)
    return F.when(~usual & bare.rlike("^[^\\x00-\\x08]*[0-9][^\\x00-\\x08]*$"), F.split(F.trim(t), " "))


def _decided(tokens: Column, year_dayfirst: bool) -> Column:
    """Day, month and year from three tokens in any order, as ``DD/MM/YYYY``; null where they are none.

    A number of four digits, or above 31, is the year.  Beside a month's name
    the day comes before the year otherwise, but after it where the month is
    last.  Three numbers are read day first.
    """
    a, b, c = (F.get(tokens, F.lit(i)) for i in range(3))
    named = [x.startswith(_SEEN["month"]) for x in (a, b, c)]
    is_year = lambda x: (F.length(x) == 4) | (x.try_cast("int") > 31)

    def month_of(word: Column) -> Column:
        return ((F.instr(F.lit(_MONTH_ORDER), F.substring(word, 2, 3)) + 2) / 3).cast("int").cast("string")

    def shown(day: Column, month: Column, year: Column) -> Column:
        good = day.rlike("^[0-9]{1,2}$") & month.rlike("^[0-9]{1,2}$") & year.rlike("^(?:[0-9]{4}|[0-9]{1,2})$")
        return F.when(good, F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(month, 2, "0"), F.when(F.length(year) == 1, F.lpad(year, 2, "0")).otherwise(year)))

    numbers = F.when(is_year(a), shown(b, c, a) if year_dayfirst else shown(c, b, a)).otherwise(shown(a, b, c))
    out = (
        F.when(named[0], F.when(is_year(b), shown(c, month_of(a), b)).otherwise(shown(b, month_of(a), c)))
        .when(named[1], F.when(is_year(a), shown(c, month_of(b), a)).otherwise(shown(a, month_of(b), c)))
        .when(named[2], F.when(is_year(b), shown(a, month_of(c), b)).otherwise(shown(b, month_of(c), a)))
        .otherwise(numbers)
    )
    return F.when(F.size(tokens) == 3, out)


def _laid_out(bare: Column, slashed: Column, words: Column, year_dayfirst: bool) -> Column:
    """``DD/MM/`` and the year, in two digits or four, for every known shape, whether or not the day exists."""
    after_year = "$2/$3/$1" if year_dayfirst else "$3/$2/$1"
    return (
        F.when(slashed.isNotNull(), slashed)
        .when(words.isNotNull(), _decided(words, year_dayfirst))
        .when(bare.rlike(_YEAR_FIRST), padded(F.regexp_replace(bare, _YEAR_FIRST, after_year)))
        .when(bare.rlike(_COMPACT), F.regexp_replace(bare, _COMPACT, after_year))
    )


def _that_exists(text: Column) -> Column:
    """Day first where that is a real day, else month first."""
    return F.when(exists(text), text).when(exists(swapped(text)), swapped(text))


def read_date(text: Column, iso_dayfirst: bool = False) -> Column:
    """Read the accepted date spellings; null where none fits.

    ``iso_dayfirst`` reads ``2001-06-05`` as 6 May, with day before month
    even after a leading year.  The forms are kept inside one expression: as
    columns of their own they would be no faster, and a filter that Catalyst
    pushes below them would repeat them thousands of times.
    """
    def of(bare: Column) -> Column:
        laid = lambda f: X.let(_laid_out(bare, f.slashed, f.words, iso_dayfirst), lambda t: X.let(_full_year(t), _that_exists))
        return X.let(_slashed(bare), lambda s: X.let(F.struct(s.alias("slashed"), _tokens(bare, s).alias("words")), laid))

    return X.let(_bare(text), of)


def from_serial(number: Column) -> Column:
    """Spreadsheet day number to text; null outside the calendar."""
    low, high = SERIAL_RANGE
    days = number.try_cast("int")
    day = F.date_add(F.to_date(F.lit(SERIAL_EPOCH)), days)
    return F.when(days.between(low, high), F.date_format(day, "dd/MM/yyyy"))


def from_day(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")
