"""DuckDB SQL for the contracts that SQL can express; each reads whole tables and whole texts."""

from __future__ import annotations

#: op13: words under a 13-word phrase that also starts in a document with a smaller id go
PHRASES_SQL = r"""
with docs as (select row_number() over () as row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
     place as (select row, coalesce(doc_id, 9223372036854775807) as id, words, unnest(range(1, greatest(len(words) - 11, 1))) as start from docs),
     phrase as (select row, id, start, list_slice(words, start, start + 12) as phrase from place),
     first as (select phrase, min(id) as least from phrase group by phrase having min(id) < max(id)),
     cut as (select row, start from phrase join first using (phrase) where id > least),
     gone as (select distinct row, unnest(range(start, start + 13)) as word from cut),
     lost as (select row, list(word) as gone_at from gone group by row),
     kept as (select docs.row, doc_id, words, coalesce(gone_at, []) as spots from docs left join lost using (row))
select doc_id, len(words)::bigint as n_words, len(spots)::bigint as n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda w, i: not list_contains(spots, i)), ' '), '')) as kept_sha256
from kept"""

#: op9: sets of 5-word shingles, links of Jaccard 0.8 or more, the smallest id that links reach
JACCARD_SQL = r"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[^\\x20\\x09-\\x0D]+') as words from documents),
     sets as (select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
                     else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) end as shingles from docs),
     each as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from sets),
     links as (select a.doc_id as a, b.doc_id as b from each a join each b on a.shingle = b.shingle and a.doc_id < b.doc_id
               group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
     ways as (select a, b from links union all select b, a from links),
     reach as (select doc_id, doc_id as met from sets union select reach.doc_id, ways.b from reach join ways on reach.met = ways.a)
select doc_id, len(shingles)::bigint as n_shingles, min(met) as component_id from sets join reach using (doc_id) group by doc_id, len(shingles)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: op12: the ten best documents of each item
SEARCH_SQL = rf"""
with words as (select 'd' as kind, row_number() over () as row, doc_id as id, {_LOWER} as text from documents
               union all select 'q', row_number() over (), item_id, {_LOWER} from benchmark),
     terms as (select kind, row, id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from words),
     sums as (select count(*) as n_docs, sum(len(terms))::bigint as n_terms from terms where kind = 'd' and len(terms) > 0),
     asked as (select distinct id as item_id, unnest(terms) as term from terms where kind = 'q'),
     docs as (select row, id as doc_id, terms, 100 - 90 + ((90 * len(terms) * n_docs) // n_terms) as m from terms, sums
              where kind = 'd' and len(terms) > 0),
     held as (select row, doc_id, m, unnest(terms) as term from docs),
     found as (select row, doc_id, m, term, count(*) as tf from held where term in (select term from asked) group by all),
     weight as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from found, sums group by term),
     scored as (select item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
                from asked join found using (term) join weight using (term) group by item_id, row, doc_id),
     ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id, row)::integer as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10"""

#: op11: near words, forms and roots; crc32 bit by bit over the UTF-8 bytes of id, colon and run
SPELLING_SQL = rf"""
with recursive runs as (select doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) as run from documents),
     counted as (select doc_id, run, count(*) as c, coalesce(doc_id::varchar, '') || ':' || run as name from runs group by doc_id, run),
     steps as (select *, flatten(list_transform(string_split(name, ''), lambda x: case when unicode(x) < 128
                   then [unicode(x), -1, -1, -1, -1, -1, -1, -1, -1]
                   else [195, -1, -1, -1, -1, -1, -1, -1, -1, unicode(x) - 64, -1, -1, -1, -1, -1, -1, -1, -1] end)) as steps from counted),
     hashed as (select run, c, xor(4294967295, list_reduce([4294967295::bigint] || steps::bigint[],
                   lambda a, k: case when k >= 0 then xor(a, k) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as h from steps),
     kept as (select case when h % 97 = 0 then left(run, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, c from hashed),
     words as (select word, sum(c)::bigint as n from kept where length(word) >= 5 group by word having sum(c) >= 3),
     spots as (select word, n, unnest(range(0, length(word))) as i from words),
     wild as (select word, n, i, left(word, i) || '_' || substr(word, i + 2) as form from spots),
     shorter as (select distinct word, n, left(word, i) || substr(word, i + 2) as form from spots),
     pairs as (select a.word, a.n, b.word as near, b.n as near_n from wild a join wild b on a.form = b.form and a.i = b.i and a.word <> b.word
               union all select a.word, a.n, b.word, b.n from shorter a join words b on a.form = b.word
               union all select b.word, b.n, a.word, a.n from shorter a join words b on a.form = b.word),
     near as (select word, n, count(*) as n_near, first(near order by near_n desc, near) as best, max(near_n) as best_n from pairs group by word, n),
     forms as (select words.word, words.n, coalesce(n_near, 0)::bigint as n_near, case when best_n >= 2 * words.n then best end as form,
                      case when best_n >= 2 * words.n then best_n end as form_n from words left join near using (word)),
     chain as (select word, word as stop, 0 as depth from forms
               union all select chain.word, forms.form, depth + 1 from chain join forms on chain.stop = forms.word where forms.form is not null),
     roots as (select word, arg_max(stop, depth) as root from chain group by word)
select word, n, n_near, form, form_n, root from forms join roots using (word)"""
