"""pagelens: crawled-page extraction and API-usage analytics as Spark table jobs.

Sub-packages:

``functions``  Column expressions (text, URLs, contacts, SEO, numbers, endpoints)
``sources``    request, payload, page and usage-log readers and writers
``operators``  DataFrame -> DataFrame jobs (views, links, media, emails, usage, audit)
``streaming``  Structured Streaming versions of the continuous jobs
``plans``      derived tables, registered queries and their reference SQL
"""

__version__ = "0.1.0"
