"""Queries over the test tables, one or more per operator, with the SQL to compare them with."""

from checks import cleaning, documents, flows, matching, messages

MODULES = (cleaning, documents, matching, messages, flows)
flagship = matching.k5_shortlists
