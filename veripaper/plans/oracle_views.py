"""The bindings once more, as SQL for the checking database."""

TITLE = "trim(split_part(split_part(text, chr(10), 1), '.', 1))"

VIEWS: dict[str, tuple[list[str], str]] = {
    "papers_v": (
        [],
        f"""select d.doc_id as paper_id, {TITLE} as title, d.text as abstract,
           case when d.doc_id % 5 = 0 then null
                when d.doc_id % 11 = 0 then concat('bad/', cast(d.doc_id as varchar))
                else concat('10.1234/d.', cast(d.doc_id as varchar)) end as doi,
           cast(case when d.doc_id % 13 = 0 then null when d.doc_id % 17 = 0 then 1890
                else 1990 + d.doc_id % 36 end as int) as year,
           case when d.doc_id % 7 = 0 then null else d.source end as venue,
           case d.doc_id % 4 when 0 then 'PENDING' when 1 then 'VALIDATED'
                when 2 then 'REJECTED' else 'NEEDS_REVIEW' end as status,
           cast(d.doc_id % 3 as int) as n_authors, d.source as source, e.ts as created_at
    from documents d join events e on e.event_id = d.doc_id""",
    ),
    "authors_v": (
        [],
        """select doc_id as paper_id, cast(k.k as int) as "order",
           case (doc_id + k.k) % 4 when 0 then 'John Smith' when 1 then 'Anna Miller'
             when 2 then concat('Jan Author', cast(doc_id % 100 as varchar)) else 'Bo Jones' end as name,
           k.k = 0 as is_corresponding
    from documents cross join (select 0 as k union all select 1 union all select 2) k
    where k.k < doc_id % 3""",
    ),
    "catalogue_v": (
        ["papers_v"],
        """select paper_id as cat_id,
           case paper_id % 4 when 1 then concat(title, ' revised') when 2 then replace(title, ' the ', ' a ')
             else title end as title, doi,
           cast(case when paper_id % 6 = 1 then year + 1 else year end as int) as year,
           case paper_id % 5 when 0 then [] when 1 then ['a smith', 'b jones'] when 2 then ['john miller']
             when 3 then ['jo smith', 'x miller'] else ['q unknown'] end as authors
    from papers_v""",
    ),
    "refs_v": (
        ["papers_v"],
        """select p.paper_id, k.k as ord, c.paper_id as cited_id,
           case (p.paper_id + k.k) % 3
             when 0 then concat('A. Smith, B. Jones, "', c.title, '," in Proc. Intl Conf ', coalesce(c.venue, 'Unknown'),
                  ', vol. ', cast(k.k as varchar), ', ', cast(coalesce(c.year, 2001) as varchar),
                  '. doi:10.1234/d.', cast(c.paper_id as varchar))
             when 1 then concat('Smith, J. (', cast(coalesce(c.year, 2002) as varchar), ') ', c.title, '. Journal of Tests')
             else concat('[', cast(k.k as varchar), '] John Miller et al., ', c.title, ', IEEE Transactions on Testing, vol. ',
                  cast(k.k as varchar), ', Selected Papers Issue ', cast(coalesce(c.year, 2003) as varchar)) end as raw_text
    from papers_v p cross join (select 1 as k union all select 2 union all select 3 union all select 4) k
    join papers_v c on c.paper_id = (p.paper_id * 7 + k.k) % (select count(*) from papers_v)""",
    ),
    "texts_v": (
        [],
        """select doc_id as paper_id,
           concat('Abstract: ', text, ' Introduction. See [', cast(doc_id % 4 + 1 as varchar), ', ',
             cast(doc_id % 7 + 1 as varchar), '] and [2-4]. Fig. ', cast(doc_id % 3 + 1 as varchar),
             ' and Figure ', cast(doc_id % 3 + 1 as varchar),
             case when doc_id % 5 = 0 then '. Smith wrote so, and Smith again.' else '.' end,
             case when doc_id % 2 = 0 then ' And fig 9. Conclusion.' else '' end) as text
    from documents""",
    ),
    "images_v": (
        [],
        """select source as job_id, doc_id as image_id, doc_id % 50 as paper_id,
           concat('img_', cast(doc_id as varchar), '.png') as filename, cast(doc_id % 12 as int) as page,
           case when doc_id % 19 = 0 then '' else md5(text) end as hash
    from documents""",
    ),
    "evidence_v": (
        [],
        """select l_orderkey as job_id, l_linenumber as image_id, 0.8 + l_discount * 2 as hash_sim,
           l_tax * 10 as ssim, l_quantity as best_match_pct, l_returnflag = 'R' as web_found
    from lineitem""",
    ),
    "requests_v": ([], "select event_id as req_id, user_id as client_key, ts from events"),
    "job_events_v": (
        [],
        """select cast(user_id as varchar) as job_id, event_id as seq, ts,
           case event_type when 'signup' then 'waiting' when 'view' then 'active' when 'click' then 'active'
             when 'purchase' then 'completed' else 'failed' end as state,
           case when event_id % 3 = 0 then null else value end as progress
    from events""",
    ),
    "alerts_v": (
        [],
        """select event_id as alert_id, event_id % 200 as paper_id, user_id,
           case event_type when 'signup' then 'PAPER_VALIDATED' when 'view' then 'PAPER_REJECTED'
             when 'click' then 'INVALID_REFERENCE' when 'purchase' then 'SUSPICIOUS_DIAGRAM'
             else 'VALIDATION_ERROR' end as type,
           case event_id % 4 when 0 then 'INFO' when 1 then 'WARNING' when 2 then 'ERROR'
             else 'CRITICAL' end as severity,
           concat('Alert ', cast(event_id as varchar)) as title, props as message,
           value > 10 as is_read, ts as created_at
    from events""",
    ),
    "diagrams_v": (
        [],
        """select vec_id as diagram_id, cast(label as bigint) as paper_id, cast(vec_id % 9 + 1 as int) as "order",
           list_aggregate(list_transform(range(0, 16), lambda q:
             lower(format('{:x}', list_sum(list_transform([0, 1, 2, 3], lambda b:
               case when cast(embedding[q * 4 + b + 1] as double) > list_median(list_transform(embedding, lambda v: cast(v as double)))
                 then (8 >> b) else 0 end))::bigint))), 'string_agg', '') as hash
    from embeddings""",
    ),
    "hits_v": (
        [],
        r"""select page_id % 20 as image_id, cast(page_id // 20 as int) as call, 0 as pos,
           case when page_id % 6 = 0 then 'https://arxiv.org/abs/shared' else url end as url,
           regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
           trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as snippet
    from pages""",
    ),
    "ocr_text_v": ([], "select conv_id * 1000 + turn as image_id, text as ocr_text from conversations"),
    "page_text_v": (
        [],
        """select paper_id, page, case when page = n_pages and page > 1 and paper_id % 3 = 0
             then concat('References', chr(10), '[1] ', text) else text end as text
    from (select paper_id, page, n_pages, string_agg(line, chr(10) order by line_no) as text
      from (select doc_id as paper_id, cast((i - 1) // 5 + 1 as int) as page,
              cast((len(string_split(text, chr(10))) - 1) // 5 + 1 as int) as n_pages,
              i as line_no, string_split(text, chr(10))[i] as line
            from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) as t(i))
      group by paper_id, page, n_pages)""",
    ),
}


def with_views(names: list[str], body: str, *more: tuple[str, str]) -> str:
    """``body`` behind the named views, what they need, and extra common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} as materialized (\n{VIEWS[name][1]})" for name in ordered]
    parts += [
        f"{name} as {'' if name.startswith('rec_') else 'materialized '}(\n{sql})" for name, sql in more
    ]
    recursive = "recursive " if any(name.startswith("rec_") for name, _ in more) else ""
    return f"with {recursive}" + ",\n".join(parts) + f"\n{body}"
