"""Language-model scores by a hierarchical Pitman-Yor model, its seating sampled by Gibbs.

A restaurant per context of two words serves the words that follow it. Contexts that end in the same word share a parent
restaurant; the parents of a class of words share one more, whose base is the add-one model of single words. Every
table of a restaurant is a customer of the same dish in its parent. A class is what one task samples: all restaurants that
are each other's relatives lie together, so no message crosses tasks while seats are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm import blocks as B
from tidebook.llm import text as X
from tidebook.llm.cluster import cut, release

#: Words of a class, about; and training tokens of a context word beyond which its contexts are dealt to several parents.
CLASS, PARENT = 1_000_000, 250_000
#: Dishes of a restaurant that are seated one at a time, and the parts of a dish's customers that are, if it has more of them.
TURNS, SHARE = 16, 16
#: Ids of what stands before a document's first words, and of all words that training lacks; its words follow.
OPENING, UNKNOWN, FIRST = 0, 1, 2
#: A customer, in the type of the tables' sizes.
ONE = np.int32(1)
#: The hashes of the end of a document.
END = (0x5BD1E9955BD1E995, 0xC2B2AE3D27D4EB4F)


def ordered(keys: np.ndarray) -> np.ndarray:
    """The order of whole numbers from 0, ties by place: keys are sorted with their places in their low bits, which takes a
    fraction of the time of ``argsort``; long ones in pieces, the low bits first."""
    low, bits = np.uint64(len(keys).bit_length()), int(keys.max(initial=0)).bit_length()
    at, order = np.arange(len(keys), dtype=np.uint64), None
    keys, room = keys.astype(np.uint64), 64 - int(low)
    for shift in range(0, max(bits, 1), room):
        piece = (keys if order is None else keys[order]) >> np.uint64(shift) << low | at
        piece.sort()
        piece &= (np.uint64(1) << low) - np.uint64(1)
        place = piece.view(np.int64)
        order = place if order is None else order[place]
    return order


def differ(*rising: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    new = np.ones(len(rising[0]), bool)
    if len(new):
        np.not_equal(rising[0][1:], rising[0][:-1], out=new[1:])
    for c in rising[1:]:
        new[1:] |= c[1:] != c[:-1]
    return new


def distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(head, group): a row of each distinct one, in rising order, and each row's number among them. Numbers are from 0."""
    keys, bits = [], 64
    for c in columns[::-1]:  # neighbours share a key while it holds them
        wide = int(c.max(initial=0)).bit_length()
        if bits + wide < 64:
            keys[-1] = keys[-1] | c.astype(np.int64) << bits
        else:
            keys, bits = [*keys, c], 0
        bits += wide
    place = ordered(keys[0])
    for k in keys[1:]:
        place = place[ordered(k[place])]
    new = differ(*(k[place] for k in keys))
    out = np.empty(len(place), np.int64)
    out[place] = np.cumsum(new) - 1
    return place[new], out


def rising(numbers: np.ndarray) -> np.ndarray:
    """The distinct ones in rising order."""
    numbers = np.sort(numbers)
    return numbers[differ(numbers)]


def series(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``many`` whole numbers from each ``first`` on, one after the other; ``first`` itself if that is one of each."""
    total = int(many.sum())
    if total == len(many) and many.all():
        return first
    return np.arange(total) + (first - (many.cumsum() - many)).repeat(many)


def counted(rising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, many): where each run of equal numbers begins, and its length."""
    new = np.empty(len(rising) + 1, bool)
    new[:1] = new[-1:] = True
    np.not_equal(rising[1:], rising[:-1], out=new[1:-1])
    edge = new.nonzero()[0]
    return edge[:-1], edge[1:] - edge[:-1]


class Level:
    """Restaurants of one depth: for each cell (restaurant, dish) its customers c and tables t, and the tables' sizes.

    ``rest`` gives each cell's restaurant, ``parent`` its cell in ``up``; the topmost level has ``base``, the probability
    of each cell's dish. A cell never has more than ``capacity`` customers.
    """

    def __init__(self, rest: np.ndarray, parent: np.ndarray, capacity: np.ndarray, up: Level | None, base: np.ndarray | None, strength: float, discount: float, random: np.random.Generator):
        self.rest, self.parent, self.up, self.base = rest, parent, up, base
        self.strength, self.discount, self.random = strength, discount, random
        self.start = np.cumsum(capacity) - capacity
        self.size = np.zeros(int(capacity.sum()) + 1, np.int32)
        # customers of a cell take its first places in ``seat``, each with its table's id; ``ids`` and ``place`` lead from
        # where a table lies in ``size`` to its id and back, those in use first
        self.seat, self.taken = np.zeros(len(self.size), np.int32), np.zeros(len(self.size), bool)
        self.ids = (np.arange(len(self.size)) - np.append(np.repeat(self.start, capacity), 0)).astype(np.int32)
        self.place = self.ids.copy()
        self.t, self.c = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
        restaurants = int(rest.max(initial=-1)) + 1
        self.tables, self.customers = np.zeros(restaurants, np.int64), np.zeros(restaurants, np.int64)

    def above(self, cells: np.ndarray) -> np.ndarray:
        """The probability of the cells' dishes in their parents."""
        return self.base[cells] if self.up is None else self.up.share(self.parent[cells])

    def share(self, cells: np.ndarray) -> np.ndarray:
        """The predictive probability of the cells' dishes in their restaurants."""
        r = self.room(cells)
        own = self.c[cells] - self.discount * self.t[cells]
        return (own + (self.strength + self.discount * self.tables[r]) * self.above(cells)) / (self.strength + self.customers[r])

    def shares(self) -> np.ndarray:
        """The same of all cells, each parent's once."""
        above = self.base if self.up is None else self.up.shares()[self.parent]
        own = self.c - self.discount * self.t
        return (own + (self.strength + self.discount * self.tables)[self.rest] * above) / (self.strength + self.customers)[self.rest]

    def at(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where the tables of these ids lie in ``size``."""
        start = self.start[cells]
        return start + self.place[start + ids]

    def pick(self, cells: np.ndarray, low: np.ndarray | None = None, absent: np.ndarray | None = None) -> np.ndarray:
        """Where tables of the cells lie in ``size``, with probability in proportion to their size less the discount.

        Of two tables their sizes decide. Of more, a random customer's table is taken or not, until one is. ``absent``
        customers from the ``low``-th on are away.
        """
        out, t = self.start[cells], self.t[cells]
        todo = (t > 1).nonzero()[0]
        if not len(todo):
            return out
        if len(todo) < len(cells):
            t = t[todo]
        two = t == 2
        few, many = todo[two], todo[~two]
        tries = 4
        while len(many):
            k = cells[many]
            start = self.start[k][:, None]
            customer = self.random.random((len(many), tries))
            if low is None:
                customer = (customer * self.c[k][:, None]).astype(np.int64)
            else:
                customer = (customer * (self.c[k] - absent[many])[:, None]).astype(np.int64)
                customer += (customer >= low[many][:, None]) * absent[many][:, None]
            customer += start
            table = start + self.place[start + self.seat[customer]]
            takes = self.random.random(table.shape) * self.size[table] >= self.discount
            first = takes.argmax(1) + np.arange(0, takes.size, tries)
            found = takes.ravel()[first]
            out[many[found]] = table.ravel()[first[found]]
            many, tries = many[~found], min(64, 4 * tries)
        if len(few):
            here = self.c[cells[few]] if absent is None else self.c[cells[few]] - absent[few]
            first = self.size[out[few]] - self.discount
            out[few] += self.random.random(len(few)) * (here - 2 * self.discount) >= first
        return out

    def open(self, guests: np.ndarray) -> None:
        """Seats the first customers of empty restaurants, ``guests`` of each cell: the first of a dish has a table of its own."""
        some = guests > 0
        self.size[self.start[some]] = 1
        self.t += some
        self.c += some
        self.tables += np.bincount(self.rest, some, len(self.tables)).astype(np.int64)
        self.customers += np.bincount(self.rest, some, len(self.customers)).astype(np.int64)
        if self.up is not None:
            self.up.open(np.bincount(self.parent, some, len(self.up.c)).astype(np.int64))
        more = np.flatnonzero(guests > 1)
        self.add(more, guests[more] - 1)

    def add(self, cells: np.ndarray, guests: np.ndarray) -> None:
        """Seats ``guests`` new customers of each cell; cells differ. Guests of a cell follow each other while there are few."""
        if not guests.all():
            cells, guests = cells[guests > 0], guests[guests > 0]
        while len(cells):
            c, t, start = self.c[cells], self.t[cells], self.start[cells]
            fresh = self.opening(cells)
            fresh /= fresh + np.maximum(c - self.discount * t, 1e-12)
            fresh[c == 0] = 1.0
            most = int(guests.max())
            now = guests if most == 1 else np.minimum(guests, np.maximum(1, c // 8))
            if most == 1 or int(now.max()) == 1:
                opens = self.random.random(len(cells)) < fresh
                joins, opened = (~opens).nonzero()[0], opens.nonzero()[0]
                if len(joins):
                    table = self.pick(cells[joins])
                    self.seat[start[joins] + c[joins]] = self.ids[table]
                    self.size[table] += ONE
                many, place = np.ones(len(opened), np.int64), start[opened] + t[opened]
                self.seat[start[opened] + c[opened]] = self.ids[place]
                fresh = opens
            else:
                fresh = self.random.binomial(now, fresh)
                joins = now - fresh
                some = joins > 0
                if some.any():
                    table = self.pick(cells[some].repeat(joins[some]))
                    self.seat[series((start + c)[some], joins[some])] = self.ids[table]
                    np.add.at(self.size, table, ONE)
                opened = fresh.nonzero()[0]
                many = fresh[opened]
                place = series(start[opened] + t[opened], many)
                self.seat[series((start + c + joins)[opened], many)] = self.ids[place]
            self.size[place] = 1
            self.c[cells] = c + now
            self.tally(self.customers, cells, now)
            if len(opened):
                parents = cells[opened]
                self.t[parents] += many
                self.tally(self.tables, parents, many)
                if self.up is not None:
                    self.up.add(*self.parents(parents, many))
            if most == 1:
                return
            guests = guests - now
            cells, guests = cells[guests > 0], guests[guests > 0]

    def opening(self, cells: np.ndarray) -> np.ndarray:
        """The weight of a new table of each cell's dish."""
        return (self.strength + self.discount * self.tables[self.room(cells)]) * self.above(cells)

    def room(self, cells: np.ndarray) -> np.ndarray | int:
        """The cells' restaurants, or that of all cells."""
        return self.rest[cells] if len(self.tables) > 1 else 0

    def tally(self, of: np.ndarray, cells: np.ndarray, many: np.ndarray) -> None:
        """Adds each cell's number to its restaurant's."""
        if len(of) > 1:
            np.add.at(of, self.rest[cells], many)
        else:
            of += many.sum()

    def remove(self, cells: np.ndarray, guests: np.ndarray) -> None:
        """Takes ``guests`` random customers from each cell; cells rise, and have that many."""
        if not len(cells):
            return
        start, c, t = self.start[cells], self.c[cells], self.t[cells]
        stay = c - guests
        self.c[cells] = stay
        self.tally(self.customers, cells, -guests)
        # of one table's customers it doesn't matter who leaves
        one = t == 1
        alone = one.nonzero()[0]
        if len(alone):
            self.size[start[alone]] = stay[alone]
            closed = cells[alone[stay[alone] == 0]]
            if len(alone) == len(cells):
                self.close(closed, np.ones(len(closed), np.int64))
                return
            more = (~one).nonzero()[0]
            cells, guests, start, c, stay = cells[more], guests[more], start[more], c[more], stay[more]
        single = guests == 1
        if single.all():
            gone = start + (self.random.random(len(cells)) * c).astype(np.int64)
        else:
            gone = start[single] + (self.random.random(int(single.sum())) * c[single]).astype(np.int64)
            gone = np.sort(np.concatenate((gone, self.chosen(start[~single], c[~single], guests[~single]))))
        empty, many = self.leave(cells, guests, gone)
        # the last customers take the places of those who left
        if len(gone) == len(cells):
            self.seat[gone] = self.seat[start + stay]
        else:
            last = series(start + stay, guests)
            self.taken[gone] = True
            last = last[~self.taken[last]]
            self.taken[gone] = False
            self.seat[gone[gone < (start + stay).repeat(guests)]] = self.seat[last]
        if len(alone) and len(closed):
            empty, many = np.concatenate((empty, closed)), np.concatenate((many, np.ones(len(closed), np.int64)))
        self.close(empty, many)

    def close(self, cells: np.ndarray, many: np.ndarray) -> None:
        """``many`` tables of each cell are gone, and leave the parents."""
        if not len(cells):
            return
        self.t[cells] -= many
        self.tally(self.tables, cells, -many)
        if self.up is not None:
            self.up.remove(*self.parents(cells, many))

    def count(self, tables: np.ndarray, change: int, apart: int) -> None:
        """Changes the sizes of the tables, which are all different if there are ``apart`` of them or fewer."""
        if len(tables) <= apart:
            self.size[tables] += change
        else:
            np.add.at(self.size, tables, change * ONE)  # of the sizes' own type, which takes a twentieth of the time

    def leave(self, cells: np.ndarray, guests: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The customers at the places ``gone``, ``guests`` of each cell, leave their tables; both rise.

        Returns the cells whose tables are empty, and how many of them; the last tables take the places of those.
        """
        if len(gone) == len(cells):
            start = self.start[cells]
            table = start + self.place[start + self.seat[gone]]
            left = self.size[table] - ONE
            self.size[table] = left
            empty = (left == 0).nonzero()[0]
            cells, hole, start = cells[empty], table[empty], start[empty]
            many = np.ones(len(cells), np.int64)
            last = start + self.t[cells] - 1
            self.size[hole] = self.size[last]
            self.size[last] = 0
        else:
            owner = cells.repeat(guests)
            table = self.at(owner, self.seat[gone])
            self.count(table, -1, len(cells))
            empty = self.size[table] == 0
            table, owner = table[empty], owner[empty]
            order = table.argsort()
            table = table[order]
            first = counted(table)[0]
            table, owner = table[first], owner[order[first]]
            head, many = counted(owner)
            cells = owner[head]
            start, end = self.start[cells], self.start[cells] + self.t[cells] - many
            last = series(end, many)
            full = self.size[last] > 0
            last, free = last[full], table < end.repeat(many)
            hole, start = table[free], start.repeat(many)[free]
            self.size[hole], self.size[last] = self.size[last], 0
        was, now = self.ids[hole], self.ids[last]
        self.ids[hole], self.ids[last] = now, was
        self.place[start + now], self.place[start + was] = hole - start, last - start
        return cells, many

    def parents(self, cells: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, n): the parents of the cells, rising, and the sums of ``many``."""
        parent = self.parent[cells]
        order = parent.argsort()
        parent = parent[order]
        head = counted(parent)[0]
        return parent[head], np.add.reduceat(many[order], head)

    def chosen(self, low: np.ndarray, of: np.ndarray, many: np.ndarray) -> np.ndarray:
        """``many`` different random whole numbers of [low, low + of) for each entry; the ranges don't overlap."""
        crowded = 2 * many > of
        out = []
        if crowded.any():
            a, b, c = low[crowded], of[crowded], many[crowded]
            owner = np.repeat(np.arange(len(a)), b)
            order = np.lexsort((self.random.random(len(owner)), owner))
            first = np.cumsum(b) - b
            rank = np.arange(len(owner)) - first[owner]
            out.append((a[owner] + order - first[owner])[rank < c[owner]])
        if not crowded.all():
            a, b, c = low[~crowded], of[~crowded], many[~crowded]
            owner = np.repeat(np.arange(len(a)), c)
            drawn = a[owner] + self.random.integers(0, b[owner])
            while True:
                order = np.argsort(drawn, kind="stable")
                again = order[1:][drawn[order][1:] == drawn[order][:-1]]
                if not len(again):
                    break
                drawn[again] = a[owner[again]] + self.random.integers(0, b[owner[again]])
            out.append(drawn)
        return np.concatenate(out)

    def move(self, cells: np.ndarray, low: np.ndarray, guests: np.ndarray) -> None:
        """Each cell's customers from the ``low``-th on, ``guests`` but not all, leave and sit down again; cells rise."""
        if not len(cells):
            return
        start, t = self.start[cells], self.t[cells]
        single = int(guests.max()) == 1
        # who leaves a dish's only table and sits down there again changes nothing
        some = (t > 1).nonzero()[0]
        if len(some):
            k = cells[some]
            gone = (start + low)[some]
            self.close(*self.leave(k, guests[some], gone if single else series(gone, guests[some])))
            t[some] = self.t[k]
        fresh = self.opening(cells)
        fresh /= fresh + (self.c[cells] - guests - self.discount * t)
        if single:
            opens = self.random.random(len(cells)) < fresh
            places, opened = start + low, opens.nonzero()[0]
            new, many = (start + t)[opened], np.ones(len(opened), np.int64)
            join = some[~opens[some]]
            who, seats = join, places[join]
        else:
            who = np.arange(len(cells)).repeat(guests)
            places = series(start + low, guests)
            opens = self.random.random(len(who)) < fresh[who]
            several = np.zeros(len(cells), bool)
            several[some] = True
            join = (several[who] & ~opens).nonzero()[0]
            who, seats, opening = who[join], places[join], who[opens]
            head, many = counted(opening)
            opened = opening[head]
            new = series((start + t)[opened], many)
        if len(join):
            table = self.pick(cells[who], low[who], guests[who])
            self.seat[seats] = self.ids[table]
            self.count(table, 1, len(table) if single else 0)
        if not len(opened):
            return
        only = np.ones(len(cells), bool)
        only[some] = False
        lone = only[opened]
        self.size[start[opened[lone]]] -= many[lone].astype(np.int32)
        self.size[new] = 1
        self.seat[places[opens]] = self.ids[new]
        opened = cells[opened]
        self.t[opened] += many
        self.tally(self.tables, opened, many)
        if self.up is not None:
            self.up.add(*self.parents(opened, many))

    def sweep(self, reach: int | None = None, turns: int = TURNS, share: int = SHARE) -> None:
        """Takes all customers from their tables, and seats each by what all others say, parents included.

        Of a dish with two customers one is enough, since the other's table is its own then, whatever it had. With ``reach``,
        no more than that of a dish leave. They go one after the other; of ``share`` customers and more, an equal part of one
        in ``share`` at once. Restaurants are served side by side. Up to ``turns`` dishes of a restaurant that have anything to
        draw are seated one customer at a time; of more, one in ``turns`` leaves and sits down with each other.
        """
        cells = np.flatnonzero(self.c > 1)
        if not len(cells):
            return
        # a cell's customers stay as many while its own level is swept
        end = self.c[cells]
        low, once = (end == 2).astype(np.int64), np.maximum(1, end // share)
        if reach is not None:
            low = (self.random.random(len(end)) * (np.maximum(end - reach, low) + 1)).astype(np.int64)
            end = np.minimum(end, low + reach)
        times = -((low - end) // once)
        step = self.steps(self.rest[cells], times, turns)
        who = np.arange(len(cells)).repeat(times)
        once = once[who]
        first = (np.arange(len(who)) - (times.cumsum() - times)[who]) * once + low[who]
        order = ordered(step)
        guests = np.minimum(once, end[who] - first)[order]
        who, first = cells[who[order]], first[order]
        edge = [0, *np.bincount(step).cumsum().tolist()]
        for i, j in zip(edge, edge[1:], strict=False):
            self.move(who[i:j], first[i:j], guests[i:j])

    @staticmethod
    def steps(rest: np.ndarray, times: np.ndarray, turns: int) -> np.ndarray:
        """When each of the dishes' ``times`` comes: at no step a dish twice, nor more of a restaurant's dishes than one in ``turns``.

        A restaurant's dishes follow each other in a line, which is cut into as many equal pieces as dishes may go at once.
        """
        order = ordered(rest)
        line = times[order]
        head, dishes = counted(rest[order])
        total = np.add.reduceat(line, head)
        long = np.maximum(np.maximum.reduceat(line, head), -(-total // -(-dishes // turns)))
        first, length = np.empty_like(times), np.empty_like(times)
        first[order] = line.cumsum() - line - (total.cumsum() - total).repeat(dishes)
        length[order] = long.repeat(dishes)
        return series(first, times) % length.repeat(times)


def discount_of(counts: np.ndarray) -> float:
    """The discount that the numbers of dishes with one customer and with two suggest."""
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5


class Model:
    """The restaurants of some contexts: triples (v, w, u), rising and distinct, of a word w after u v, with their counts.

    ``word`` holds the distinct words w and ``base`` their probabilities in the base. A triple may have no customers.
    """

    def __init__(self, v: np.ndarray, w: np.ndarray, u: np.ndarray, count: np.ndarray, word: np.ndarray, base: np.ndarray, strength: float, random: np.random.Generator):
        new = differ(v, w)
        pair = np.cumsum(new) - 1  # the parent's cell
        heads = np.flatnonzero(new)
        dish = distinct(w[heads])[1]
        # restaurants are numbered; all cells of a context of two words lie apart, in the order of w
        room = np.cumsum(differ(v)) - 1
        _, context = distinct(room, u)
        parent_rest = room[heads]
        total = np.bincount(pair, count, len(heads)).astype(np.int64)
        kinds = np.bincount(pair, count > 0, len(heads)).astype(np.int64)
        root_total = np.bincount(dish, total, len(word)).astype(np.int64)
        root_kinds = np.bincount(dish, kinds > 0, len(word)).astype(np.int64)
        self.root = Level(np.zeros(len(word), np.int64), np.zeros(0, np.int64), root_total, None, base, strength, discount_of(root_kinds), random)
        self.middle = Level(parent_rest, dish, total, self.root, None, strength, discount_of(kinds), random)
        self.leaves = Level(context, pair, count, self.middle, None, strength, discount_of(count), random)
        self.count = count

    def shares(self, burn_in: int, draws: int) -> np.ndarray:
        """The predictive probability of each triple's w after u v: the mean over ``draws`` seatings after ``burn_in`` sweeps."""
        self.leaves.open(self.count)
        out = np.zeros(len(self.count))
        for k in range(burn_in + draws):
            for level in (self.leaves, self.middle, self.root):
                level.sweep()
            if k >= burn_in:
                out += self.leaves.shares()
        return out / max(draws, 1) if draws else self.leaves.shares()


@dataclass
class Tokens:
    """A block's tokens, words with A-Z lower-cased, then an end, per document, as numbers of distinct ones."""

    ids: np.ndarray  # of documents
    missing: np.ndarray
    marked: np.ndarray
    size: np.ndarray  # tokens of each document
    which: np.ndarray  # of each token
    doc: np.ndarray
    train: np.ndarray

    @staticmethod
    def split(batch: pa.RecordBatch) -> tuple[Tokens, np.ndarray, np.ndarray]:
        """(tokens, hashes, checks) of rows (id, marked, text); distinct tokens are numbered by rising hashes."""
        data, offsets = X.buffer(batch.column("text"))
        which, digests, size = X.distinct_words(data, offsets, fold=True)
        token = np.full(len(which) + len(size), len(digests))
        token[np.arange(len(which)) + np.repeat(np.arange(len(size)), size)] = which
        digests = np.concatenate((digests, np.array([END], np.uint64)))
        order = ordered(digests[:, 0])
        if not differ(digests[order, 0]).all():
            order = np.lexsort((digests[:, 1], digests[:, 0]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        digests = digests[order]
        ids = batch.column("id")
        made = Tokens.of(np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(batch.column("marked")), size + 1, place[token])
        return made, digests[:, 0], (digests[:, 1] >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def of(ids: np.ndarray, missing: np.ndarray, marked: np.ndarray, size: np.ndarray, which: np.ndarray) -> Tokens:
        doc = np.repeat(np.arange(len(size)), size)
        return Tokens(ids, missing, marked, size, which, doc, marked[doc])

    def pack(self) -> list[bytes]:
        return [B.pack(self.ids), B.pack_small(self.missing), B.pack_small(self.marked), B.pack_small(self.size), B.pack_small(self.which)]

    @staticmethod
    def unpack(body: list[bytes]) -> Tokens:
        ids, missing, marked, size, which = map(B.unpack, body)
        return Tokens.of(ids, missing.astype(bool), marked.astype(bool), size.astype(np.int64), which.astype(np.int64))

    @staticmethod
    def known(answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each of a block's distinct tokens, as its word buckets say; UNKNOWN and 0 where training has none."""
        ids, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in sorted(answers, key=lambda a: a["bucket"]):  # buckets are ranges of hashes
            number = B.unpack(a["body"][0]).astype(np.int64)
            ids.append(np.where(number > 0, number - 1 + FIRST + a["base"], UNKNOWN))
            count.append(B.unpack(a["body"][1]).astype(np.int64))
        return np.concatenate(ids), np.concatenate(count)


@dataclass
class Triples:
    """A block's distinct (v, w, u), rising, w after u v, with the class of each; ``which`` of each token that has one.

    Tokens after a word that training lacks have none: they have the base's probability.
    """

    v: np.ndarray
    w: np.ndarray
    u: np.ndarray
    part: np.ndarray
    which: np.ndarray
    has: np.ndarray
    dish: np.ndarray  # the place of each w in ``name``, which has the block's ids, rising, and their training counts in ``told``
    name: np.ndarray
    told: np.ndarray

    @staticmethod
    def of(t: Tokens, ids: np.ndarray, count: np.ndarray, classes: int, parent: int = PARENT) -> Triples:
        # places of ids among the block's own take the ids' part: OPENING is 0, UNKNOWN 1
        every = np.concatenate(([OPENING, UNKNOWN], ids))
        head, place = distinct(every)
        name, place = every[head], place[2:]
        w = place[t.which]
        first = differ(t.doc)
        before = lambda x: np.where(first, OPENING, np.r_[OPENING, x[:-1]]) if len(x) else x
        v = before(w)
        u = before(v)
        has = v != UNKNOWN
        v, w, u = v[has], w[has], u[has]
        b = len(name).bit_length()
        if b <= 21:
            triple = (v << b | w) << b | u
            order = ordered(triple)
            triple = triple[order]
            new = differ(triple)
            which = np.empty(len(order), np.int64)
            which[order] = np.cumsum(new) - 1
            triple = triple[new]
            v, w, u = triple >> 2 * b, triple >> b & (1 << b) - 1, triple & (1 << b) - 1
        else:
            head, which = distinct(v, w, u)
            v, w, u = v[head], w[head], u[head]
        u = name[u]
        # contexts of a common word are dealt to several parents, by the word before
        size = np.zeros(len(name), np.int64)
        size[place[count > 0]] = count[count > 0]
        parents, mixed = (1 + size // parent).astype(np.uint64), X.mix(name.astype(np.uint64))
        part = (X.mix(mixed) % np.uint64(classes)).astype(np.int64)[v]
        dealt = np.flatnonzero((parents > 1)[v])
        half = X.mix(u[dealt].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % parents[v[dealt]]
        part[dealt] = (X.mix(mixed[v[dealt]] + half) % np.uint64(classes)).astype(np.int64)
        return Triples(name[v], name[w], u, part, which, has, w, name, size)

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(class, places), places rising."""
        order = ordered(self.part)
        cuts = np.flatnonzero(np.diff(self.part[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            yield int(self.part[at[0]]), at


def edges(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of rising 64-bit numbers."""
    place = ((hashes >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(40)).astype(np.int64)
    edge = np.searchsorted(place, np.arange(buckets + 1)) if buckets <= len(place) else None
    if edge is None:
        found, at = np.unique(place, return_index=True)
        yield from zip(found.tolist(), at.tolist(), [*at[1:].tolist(), len(place)], strict=True)
        return
    for b in np.flatnonzero(np.diff(edge)).tolist():
        yield b, int(edge[b]), int(edge[b + 1])


MESSAGE = "bucket long, sender long, kind int, body array<binary>"
_TYPES = pa.schema([("bucket", pa.int64()), ("sender", pa.int64()), ("kind", pa.int32()), ("body", pa.list_(pa.binary()))])


def messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(_TYPES.names, r, strict=True)) for r in rows], _TYPES)


def pack_triples(v: np.ndarray, w: np.ndarray, u: np.ndarray, count: np.ndarray, of_word: np.ndarray) -> list[bytes]:
    """Rising triples with their counts, and the count of each distinct w."""
    new = np.r_[True, v[1:] != v[:-1]]
    return [B.pack_small(np.diff(v, prepend=0)), B.pack_small(np.where(new, w, np.diff(w, prepend=0))), B.pack_small(u), B.pack_small(count), B.pack_small(of_word)]


def unpack_triples(body: list[bytes]) -> tuple[np.ndarray, ...]:
    step, w, u, count, of_word = (B.unpack(x).astype(np.int64) for x in body)
    new = step > 0
    new[:1] = True
    total = np.cumsum(w)
    start = np.flatnonzero(new)
    w = total - np.repeat(total[start] - w[start], np.diff(np.r_[start, len(w)]))
    return np.cumsum(step), w, u, count, of_word


def scores(docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text", burn_in: int = 1, draws: int = 2, strength: float = 1.0, seed: int = 10) -> DataFrame:
    """A row per document: doc_id, training, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``training`` is a boolean column: the model learns from these documents alone and scores all. Tokens are words
    with A-Z lower-cased, and an end per document; null texts have the end only. score sums log10 of the predictive
    probabilities after the two words before, each the mean of ``draws`` seatings after ``burn_in`` Gibbs sweeps, and
    perplexity is 10 ** (-score / n_tokens). base_score is the add-one model of single tokens, which is also the base of
    the topmost restaurants, and what a token after an unknown word has. A sweep takes all customers from their tables
    and seats them anew by what all others say (``Level.sweep``); since the first seating follows the model, too, few
    sweeps bring scores close to those of many (README). Discounts follow from how many dishes have one customer
    and two. Without training documents the score is that of the base alone.

    Contexts are dealt to classes of about CLASS tokens by their last word, those of a word with over PARENT tokens by the
    word before, too, so a task's share is bounded but for the distinct words that follow one context. Messages hold each
    key once per block and class: neither common words nor common passages gather anywhere. Words are told apart by 96
    bits of XXH3, by their bytes within a block. Reruns agree. Document ids are whole numbers; rows of equal or null id
    are documents of their own.
    """
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be a whole number, not {docs.schema[doc_id].dataType.simpleString()}")
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(training, F.lit(False)).alias("marked"), F.col(text).cast("string").alias("text"))
    # six bytes a word, about: only how finely keys are dealt depends on it
    words = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    n, classes, most, held = max(1, -(-words // B.BUCKET)), max(1, -(-words // CLASS)), PARENT, B.BLOCK
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = lambda df, key, groups: df.repartition(max(parts, groups), key)

    # 1. words: each block's distinct tokens, with training counts; buckets count and number them. A block's tokens
    # themselves go along to the written table, in a bucket of their own
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(X.pieces(batches, "text", held)):
            t, hashes, checks = Tokens.split(batch)
            block = part << 32 | k
            count = np.bincount(t.which, t.train, len(hashes)).astype(np.int64)
            asks = [(b, block, 0, [B.pack_sorted(hashes[i:j]), B.pack(checks[i:j]), B.pack_small(count[i:j])]) for b, i, j in edges(hashes, n)]
            yield from messages([(-1 - block, block, 9, t.pack()), *asks]).to_batches()

    def count_words(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table
        bodies = table["body"].to_pylist()
        hashes = [B.unpack_sorted(b[0]) for b in bodies]
        order, new = B.sorted_unique(np.concatenate(hashes), np.concatenate([B.unpack(b[1]) for b in bodies]))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        count = np.bincount(group, np.concatenate([B.unpack(b[2]) for b in bodies])).astype(np.int64)
        number = np.where(count > 0, np.cumsum(count > 0), 0)
        out = [(key[0].as_py(), -1, 0, [int((count > 0).sum()).to_bytes(8, "big"), int(count.sum()).to_bytes(8, "big")])]
        for sender, g in zip(table["sender"].to_pylist(), np.split(group, np.cumsum([len(h) for h in hashes])[:-1]), strict=True):
            out.append((key[0].as_py(), sender, 1, [B.pack_small(number[g]), B.pack_small(count[g])]))
        return messages(out)

    told = cut(wide(rows.mapInArrow(tokenise, MESSAGE), "bucket", n).groupBy("bucket").applyInArrow(count_words, MESSAGE))
    release(spark)
    blocks = told.where("kind = 9").select(F.col("sender").alias("block"), F.col("body").alias("body"))
    big = lambda i: F.conv(F.hex(F.col("body")[i]), 16, 10).cast("long")
    sizes = told.where("kind = 0").select("bucket", big(0).alias("words"), big(1).alias("tokens"))
    vocabulary, tokens = (int(x or 0) for x in sizes.agg(F.sum("words"), F.sum("tokens")).first())
    # the ids of a bucket's words follow those of the buckets before it: a row per bucket
    before = sizes.select(F.col("bucket").alias("_b"), F.coalesce(F.sum("words").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    known = told.where("kind = 1").join(before, F.col("bucket") == F.col("_b")).select(*(F.col(c).alias(c) for c in ("sender", "bucket", "base", "kind", "body")))
    count_blocks = blocks.count()

    # 2. triples: each block's distinct ones, with training counts; classes seat them, and answer with probabilities
    def ask_triples(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        answers = answers.to_pylist()
        for row in block.to_pylist():
            t = Tokens.unpack(row["body"])
            ids, count = Tokens.known(answers)
            x = Triples.of(t, ids, count, classes, most)
            times = np.bincount(x.which, t.train[x.has], len(x.v)).astype(np.int64)
            for part, at in x.parts():
                of_word = x.told[rising(x.dish[at])]
                out.append((part, row["block"], 2, pack_triples(x.v[at], x.w[at], x.u[at], times[at], of_word)))
        return messages(out)

    def seat(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        senders = table["sender"].to_pylist()
        got = [unpack_triples(b) for b in table["body"].to_pylist()]
        v, w, u, count = (np.concatenate([g[i] for g in got]) for i in range(4))
        word = np.concatenate([rising(g[1]) for g in got])
        at = distinct(word)[0]
        word = word[at]
        base = (np.concatenate([g[4] for g in got])[at] + 1.0) / (tokens + 1.0 * (vocabulary + 1))
        head, group = distinct(v, w, u)
        count = np.bincount(group, count).astype(np.int64)
        random = np.random.Generator(np.random.PCG64([seed, part]))
        share = Model(v[head], w[head], u[head], count, word, base, strength, random).shares(burn_in, draws).astype(np.float32)
        cuts = np.cumsum([len(g[0]) for g in got])[:-1]
        # 16 bits of each fraction: rounding moves a logarithm by a few millionths
        share = ((share.view(np.uint32) + np.uint32(0x40)) & np.uint32(0xFFFFFF80)).view(np.float32)
        return messages([(part, sender, 3, [B.pack(share[g])]) for sender, g in zip(senders, np.split(group, cuts), strict=True)])

    by_block = lambda df, column: wide(df, column, count_blocks).groupBy(column)
    asked = by_block(blocks, "block").cogroup(by_block(known, "sender")).applyInArrow(ask_triples, MESSAGE)
    seated = cut(wide(asked, "bucket", classes).groupBy("bucket").applyInArrow(seat, MESSAGE))
    del asked
    release(spark)

    # 3. blocks score their documents
    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        answers = answers.to_pylist()
        share_of = {a["bucket"]: a["body"][0] for a in answers if a["kind"] == 3}
        told_words = [a for a in answers if a["kind"] == 1]
        for row in block.to_pylist():
            t = Tokens.unpack(row["body"])
            ids, count = Tokens.known(told_words)
            x = Triples.of(t, ids, count, classes, most)
            share = np.zeros(len(x.v))
            for part, at in x.parts():
                share[at] = B.unpack(share_of[part])
            base = np.log10((count + 1.0) / (tokens + 1.0 * (vocabulary + 1)))[t.which]
            each = base.copy()
            if tokens:
                each[x.has] = np.log10(share)[x.which]
            docs_ = len(t.ids)
            total = lambda values: np.bincount(t.doc, values, docs_)  # noqa: B023, E731
            size, whole = total(None), total(each)
            parts.append(
                pa.table(
                    {
                        "doc_id": pa.array(t.ids, pa.int64(), mask=t.missing),
                        "training": pa.array(t.marked),
                        "n_tokens": size.astype(np.int64),
                        "n_known": total((count > 0)[t.which]).astype(np.int64),
                        "train_tokens": np.full(docs_, tokens, np.int64),
                        "base_score": total(base),
                        "score": whole,
                        "perplexity": 10 ** (-whole / size),
                    }
                )
            )
        return pa.concat_tables(parts)

    answers = known.union(seated.select("sender", "bucket", F.lit(0).cast("long"), "kind", "body"))
    schema = "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return by_block(blocks, "block").cogroup(by_block(answers, "sender")).applyInArrow(score, schema)
