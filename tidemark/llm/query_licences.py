"""Licences in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.licence_scan import Template, scan_licences

# The phrases and labels of the query's contract.
PHRASES = (
    Template("mit", "mit license"),
    Template("apache", "apache license"),
    Template("gpl", "general public license"),
)

# The words by which public licences are announced.
TEMPLATES = (
    Template("mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions"""),
    Template("mit", "Released under the MIT License."),
    Template("apache", """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    Template("apache", "Licensed under the Apache License, Version 2.0."),
    Template("gpl", """
        This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation, either version
        3 of the License, or (at your option) any later version."""),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3."),
    Template("bsd", """
        Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met"""),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-nc", """
        This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International
        License."""),
)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licences(docs, TEMPLATES, PHRASES).withColumnRenamed("id", "doc_id")


QUERIES = {"op7_licence_scan": op7_licence_scan}
ORACLES: dict[str, str] = {}
