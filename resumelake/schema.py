"""Schemas of the documents that the package reads and writes."""

from __future__ import annotations

#: A structured CV, for from_json.
CV = """
personal_info struct<first_name:string,last_name:string,address:string,phone:string,email:string,linkedin:string,website:string>,
summary string,
experience array<struct<experience_id:string,start_date:string,end_date:string,is_current:boolean,company:string,role:string,location:string,employment_type:string,description:string,technologies:array<string>,evidence:string>>,
education array<struct<degree:string,institution:string,start_date:string,end_date:string,location:string>>,
skills struct<programming_languages:array<string>,technologies:array<string>,soft_skills:array<string>>,
projects array<struct<experience_id:string,start_date:string,end_date:string,project_name:string,customer:string,industry:string,role:string,role_description:string,technologies:array<string>,evidence:string>>,
certifications array<struct<title:string,issuer:string,year:int,evidence:string>>,
languages array<struct<language:string,proficiency:string>>,
interests array<string>
""".replace("\n", " ").strip()
#: A row for each technology of a CV.
TECHNOLOGY = "struct<technology:string,total_months:int,experience_count:bigint,project_count:bigint,last_used_date:string,is_current:boolean>"
