"""Schemas of the engine's tables, as DDL strings for spark.read.schema() and createDataFrame()."""

from __future__ import annotations

#: Columns of the tables and their types.
ELEMENTS = "doc_id long, seq int, type string, text string, page_number int, section string, filename string"
CHUNKS = "document_id long, chunk_index int, text string, source_file string, section_title string, page_number int, doc_type string, extra map<string,string>"
TENDERS = "id long, title string, client string, description string, deadline timestamp, status string, source_file_url string, budget_estimate double, category string, tags array<string>, metadata_json string, created_by long, created_at timestamp, updated_at timestamp"
REQUIREMENTS = "id long, tender_id long, requirement_text string, category string, priority string, compliance_status string, proposal_section_id long, created_at timestamp"
PROPOSALS = "id long, tender_id long, title string, status string, version int, notes string, created_by long, created_at timestamp, updated_at timestamp"
SECTIONS = "id long, proposal_id long, title string, content string, order int, assigned_to long, status string, created_at timestamp, updated_at timestamp"
CONTENT_BLOCKS = "id long, title string, content string, category string, tags array<string>, usage_count long, quality_rating double, created_by long, created_at timestamp, updated_at timestamp"
PROJECTS = "id string, name string, description string, category string, client string, value string, year string, team_members array<struct<id:string,name:string,title:string,role:string>>, certifications array<string>"
MEMBERS = "id string, name string, title string, years_experience int, certifications array<string>, skills array<string>"
#: Titles of the sections that a new proposal starts with.
DEFAULT_SECTIONS = [
    "Executive Summary",
    "Company Overview",
    "Technical Approach",
    "Team & Key Personnel",
    "Past Performance & References",
    "Project Timeline",
    "Pricing & Budget",
    "Compliance Matrix",
]
#: Each table's key, and which column refers to which table; whether a row goes with the one it refers to.
KEYS = {"users": "id", "tenders": "id", "requirements": "id", "proposals": "id", "sections": "id", "otp_tokens": "id", "search_history": "id"}
REFERENCES = [
    ("otp_tokens", "user_id", "users", True),
    ("search_history", "user_id", "users", True),
    ("tenders", "created_by", "users", False),
    ("requirements", "tender_id", "tenders", True),
    ("requirements", "proposal_section_id", "sections", False),
    ("proposals", "tender_id", "tenders", True),
    ("proposals", "created_by", "users", False),
    ("sections", "proposal_id", "proposals", True),
    ("sections", "assigned_to", "users", False),
]
#: What a new row of a table has where nothing is given.
DEFAULTS = {
    "tenders": {"status": "draft", "tags": [], "metadata_json": "{}"},
    "requirements": {"priority": "medium", "compliance_status": "not_addressed"},
    "proposals": {"status": "draft", "version": 1},
    "sections": {"content": "{}", "order": 0, "status": "todo"},
    "content_blocks": {"tags": [], "usage_count": 0, "quality_rating": 0.0},
}
