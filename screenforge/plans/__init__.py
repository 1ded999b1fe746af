"""The three flows of screening: intake, shortlist, invitation."""
