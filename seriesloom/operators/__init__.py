"""Relational and sequence operators over keyed, ordered rows."""
