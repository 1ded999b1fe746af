"""Screening of job applications as Spark jobs: resume files to text, candidate records,
one application per role and email, weighted shortlists per job request, invitation messages."""
